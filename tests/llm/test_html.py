import html as html_lib
import re

from tests.conftest import DATA
from vicinal.llm import html_main
from vicinal.llm.queries import op6_host_consensus

PAGES = "page_id long, url string, html string, text string, winners string, host string"


def articles(page):
    """The article of the test pages, by plain patterns."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    text = re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"</?(p|h1|br|li)\b[^>]*>", " ", m[1])) if m else ""
    return " ".join(html_lib.unescape(text).split())


def test_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    rows = op6_host_consensus(spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == articles(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_parts_that_are_not_the_article():
    page = """<!doctype html><html><head><title>Site &lt;x&gt;</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="home nav">
    <header class="site-header"><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies on this site a lot</div>
    <main><article class="post-17"><header><h1>A  title &amp; more</h1></header><p>First <b>bo</b>ld<br>line.<p>Second&nbsp;one<!-- no > --> here.
    <ul><li>point one<li>point two</ul><div class="ad-slot">Buy now</div><form><input value="x">Search</form><aside>See also</aside><figure><img src="a>b.png" alt=">"><figcaption>Shown</figcaption></figure>
    <table><tr><td>1<td>2<tr><td>3</table><div id=comments><p>First!</p></div><div hidden>secret</div></article></main>
    <footer>&copy; 2020</footer></body></html>"""
    assert html_main.extract(page, []) == "A title & more First bold line. Second one here. point one point two Shown 1 2 3"


def test_malformed_pages():
    assert html_main.extract("", []) == "" and html_main.extract("plain text", []) == "plain text"
    assert html_main.extract("<p>a<div>b</p></div></div>c <b", []) == "a b c"
    assert html_main.extract("<article><p>x &am", []) == "x &am"
    assert html_main.extract("<script>never closed <p>x", []) == "" and html_main.extract("<!-- never closed <p>x", []) == ""
    assert html_main.extract("1 < 2 and 3 > 2 <i>so</i>", []) == "1 < 2 and 3 > 2 so"


def test_pages_are_read_in_linear_time():
    for page in ("<" * 100_000, "<a " * 50_000, "<a href='" * 30_000, "<div>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<div>x<p>y</p>" * 30_000, "&" * 100_000, "<!--" * 50_000, "<p " + "x='" * 50_000):
        html_main.read(page)


def test_hosts_decide(spark):
    """A page whose comments are longer than its article follows its host."""
    page = "<html><body><div class='box-1'>{}</div><div class='zone'>{}</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format("long article text " * 30, "talk"), "x", "y", "z") for i in range(20)]
    rows += [(99, "https://u@H.example:80/z", page.format("short article", "endless talk " * 50), "x", "y", "z"), (100, "http://other.example/", page.format("short article", "endless talk " * 50), "x", "y", "z")]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == ("long article text " * 30).strip()
    assert got[99] == "short article" and got[100].startswith("endless")


def test_odd_pages(spark):
    rows = [(1, None, None, "a", "b", "c"), (2, "", "", "a", "b", "c"), (None, "no url", "<p>x</p>", "a", "b", "c"), (3, None, "<p>" + "word " * 200_000, "a", "b", "c"), (3, None, "<p>" + "word " * 200_000, "a", "b", "c"), (4, "http://a/", "<nav>only</nav>", "a", "b", "c")]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html_main.main_text(df).collect())
    assert got == sorted([("1", 0), ("2", 0), ("None", 1), ("3", 999_999), ("3", 999_999), ("4", 0)])
    assert html_main.main_text(df.limit(0)).count() == 0


def test_nothing_of_an_article_is_left_beside():
    words = "some words of it " * 20
    for page in (
        f"<article><h1>Title</h1><p>{words}</p><ul><li>{words * 3}</ul></article>",
        f"<article><h1>Title</h1><p>{words}</p><table><tr><td>{words * 3}</table></article>",
        f"<main><h1>Title</h1><div class='content'>{words}</div></main>",
        f"<article><div class='part'>{words * 3}</div><div class='story'>{words * 2}</div></article>",
        f"<div><h1><a href='/'>Title</a></h1><div class='content'>{words}</div></div>",
        f"<div><div><h2>Title</h2></div><div>{words}</div></div>",
        f"<div><article>{words}</article><article>{words * 2}</article></div>",
        f"<h1>Title</h1><main>{words}</main>",
    ):
        page = f"<html><body>{page}</body></html>"
        assert html_main.extract(page, []) == " ".join(re.sub("<[^>]*>", " ", page).split()), page
    page = f"<body><div id='left'>others</div><div><main><h1>Title</h1>{words}</main></div></body>"
    assert html_main.extract(page, []) == f"Title {words}".strip()


def test_hosts_don_t_cut_articles(spark):
    """A winning path that holds a small part of a page isn't its article, unless the host leaves out the rest elsewhere."""
    lists, words = "point of a list " * 30, "text of a story " * 30
    rows = [(i, f"http://h.example/{i}", f"<html><body><div class='list'>{lists}</div></body></html>", "x", "y", "z") for i in range(20)]
    rows.append((99, "http://h.example/99", f"<html><body><div class='story'>{words * 3}</div><div class='list'>{lists}</div></body></html>", "x", "y", "z"))
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == lists.strip() and got[99] == f"{words * 3}{lists}".strip()


def test_names_of_wrappers_don_t_drop_the_article():
    words = "some words of it " * 20
    for page in (
        f"<div class='content-sidebar-wrap'><main>{words}</main><div class='sidebar'>others</div></div>",
        f"<div class='page has-sidebar'><div>{words}</div></div>",
        f"<section class='post category-social'>{words}</section>",
        f"<div class='masthead-layout'><main>{words}</main></div>",
        f"<main><svg viewBox='0'/>{words}<math />",
        f"<div class='related'>{words}</div>",
    ):
        assert html_main.extract(f"<html><body>{page}</body></html>", []) == words.strip(), page
    # where the article is elsewhere names count as before
    page = f"<body><article>{words}</article><div class='comments'>{words * 3}</div><div class='related'><article>{words}</article></div></body>"
    assert html_main.extract(page, []) == words.strip()
    assert html_main.extract("<p>a<svg><path/>no</svg>b", []) == "ab"
    assert html_main.extract("<div class='ad'>only</div>", []) == "only" and html_main.extract("<nav>only</nav>", []) == ""


def test_deep_pages_take_little_memory():
    """100,000 nested containers with texts and others beside them."""
    import tracemalloc

    page = "<div class='a b'><div class='c'>beside</div>text" * 50_000
    tracemalloc.start()
    text = html_main.extract(page, [])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 250e6 and text.count("text") == 50_000


def plain(pages):
    """Votes and choice by loops, paths as tuples of labels; pages (url, html)."""
    import urllib.parse
    from collections import Counter

    def way(node):
        out = ()
        while node.parent is not None:
            out = (node.path, *out)
            node = node.parent
        return out

    made = []
    for url, page in pages:
        host = urllib.parse.urlsplit((url or "").lower()).hostname or ""
        root, blocks = html_main.read(page or "")
        made.append((host, root, blocks, html_main.best(root)))
    votes, beside = Counter(), Counter()
    for host, _, blocks, node in made:
        if blocks:
            votes[host, way(node)] += 1
            up, found = node, set()
            while up.parent is not None:
                found |= {way(x) for x in up.parent.children if x.all_chars and way(x) != way(up)}
                up = up.parent
            for other in found - {way(node)[:k] for k in range(len(way(node)) + 1)}:
                beside[host, way(node), other] += 1
    out = []
    for host, root, blocks, node in made:
        total = sum(n for (h, _), n in votes.items() if h == host)
        ranked = sorted((-n, p[-1] if p else 0, p) for (h, p), n in votes.items() if h == host and n * html_main.VOTES >= total)
        every = [root]
        for x in every:
            every += x.children

        def under(x, path):
            return way(x)[: len(path)] == path

        text = None
        for n, _, path in ranked:
            outside = {o for (h, p, o), m in beside.items() if h == host and p == path and m * 2 >= -n}
            held = left = 0
            for x in every:
                own = x.chars - sum(c.chars for c in x.children)
                if under(x, path):
                    held += own
                elif not any(under(x, o) for o in outside):
                    left += own
            if any(way(x) == path for x in every) and held >= html_main.SHARE * (held + left):
                text = " ".join(t for x, t in blocks if under(x, path))
                if text:
                    break
        out.append(text or " ".join(t for x, t in blocks if any(x is y or y is node for y in [x]) or under(x, way(node)) and _within(x, node)))
    return out


def _within(x, node):
    while x is not None:
        if x is node:
            return True
        x = x.parent
    return False


def test_votes_against_plain_loops(spark):
    import random

    rng = random.Random(3)
    parts = ["<div class='story-{n}'>{w}</div>", "<div class='box'>{w}</div>", "<aside>{w}</aside>", "<section class='x'><div class='story-{n}'>{w}</div></section>", "<div id='q'>{w}</div>", "<ul><li>{w}</ul>", "<article>{w}</article>", "<div class='story-1'><p>{w}</p><div class='inner'>{w}</div></div>"]
    pages = []
    for i in range(400):
        host = rng.choice(["a.example", "b.example", "c.example", "d.example"])
        body = "".join(rng.choice(parts).format(n=rng.randrange(9), w=f"w{i} some words of it " * rng.choice([1, 3, 20])) for _ in range(rng.randrange(4)))
        pages.append((rng.choice([f"http://{host}/{i}", f"HTTPS://u@{host.upper()}:8080/?{i}", None]), rng.choice(["<html><body>{}</body></html>", "<div class='wrap'>{}</div>"]).format(body)))
    want = plain(pages)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_all_templates_of_a_host(spark):
    """Six templates that share a host's votes all win."""
    rows = [(i, f"http://h.example/{i}", f"<body><div class='t{'abcdef'[i % 6]}'>{'long text of it ' * 30}</div><div class='zone'>talk</div></body>", "x", "y", "z") for i in range(60)]
    rows += [(100 + k, f"http://h.example/{100 + k}", f"<body><div class='t{c}'>short text</div><div class='zone'>{'endless talk ' * 40}</div></body>", "x", "y", "z") for k, c in enumerate("abcdef")]
    df = spark.createDataFrame(rows, PAGES)
    assert len(html_main.winning_paths(df).first()["winners"]) >= 6
    got = {r["page_id"]: r["text"] for r in html_main.main_text(df).collect()}
    assert all(got[100 + k] == "short text" for k in range(6))
