import math
import random

import pytest

from gridloom.llm import html, topk


def plain_top(rows, every=50, k=5):
    import math

    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in whole if c != q and len(a) == len(b))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e15])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "ROWS", 40)
    rng = random.Random(1)
    rows = [(i, [float(rng.choice([-1, 0, 0.25, 1]) * scale) for _ in range(6)]) for i in range(700)]
    rows += [(701, None), (750, [None, 1.0]), (800, [float("nan")] * 6), (850, [1.0, 2.0]), (900, [3.0, 4.0]), (None, [1.0] * 6), (950, []), (-50, [scale] * 6), (-1, [scale] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, block int, id string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(frame).select("query_id", "rank", "vec_id", "score").collect())
    want = plain_top(rows)
    want = [(q, r, c, max(min(s, 2**63 - 1), -(2**63) + 1)) for q, r, c, s in want]
    if scale < 1e15:
        assert got == want
    else:
        assert [g[:2] for g in got] == [w[:2] for w in want] and sorted(g[3] for g in got) == sorted(w[3] for w in want)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_cells_grow_with_what_a_task_holds():
    """A billion vectors of 64 components and 20 million queries: copies of both sides in proportion to the square root of the work, not to its eighth."""
    q_bytes, c_bytes = 512 * (8 + 128), 4096 * (8 + 128)
    nq, nc = 20_000_000 // 512, 10**9 // 4096
    down, over = topk.grid(nq, nc, q_bytes, c_bytes, 4000)
    assert -(-nq // down) * q_bytes <= topk.QUERY_BYTES and -(-nq // down) * -(-nc // over) <= topk.TILES * 1.05
    moved = nq * over * q_bytes + nc * down * c_bytes
    assert moved < 40e12 and moved * 20 < nq * (nc // 8) * q_bytes + nc * (nq // 8) * c_bytes
    assert topk.grid(3, 20, 1000.0, 8000.0, 12) == (1, 12) and topk.grid(0, 0, 0, 0, 12) == (1, 1)
    wide = topk.grid(1000, 1000, 1 << 25, 1 << 28, 12)
    assert wide[0] == 500


ARTICLE = "<article><header><h1>Title &amp; more</h1></header><p>First  paragraph\nwith <b>bold</b> and <a href='x'>link</a>, long enough to count as text of a page.</p><p>Second paragraph.<br>After a break it goes on for quite some words.</p></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a = "</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="main">{ARTICLE}</div><aside>Related things</aside><form>Name <input></form><div id="comments"><p>First! A reader's remark that is long.</p></div><footer>&copy; 2020</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph with bold and link, long enough to count as text of a page.\nSecond paragraph. After a break it goes on for quite some words."


def test_main_text_of_pages():
    assert html.main_text(PAGE) == TEXT
    assert html.main_text(PAGE.replace("</body></html>", "")) == TEXT
    assert html.main_text(None) == html.main_text("") == html.main_text(" \n") == html.main_text("<html><body></body></html>") == ""
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<p>open <b>bold <i>deep<p>next &lt;tag&gt; &#233;") == "open bold deep\nnext <tag> é"
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.main_text("<") == "<" and html.main_text("<!-- open") == "" and html.main_text("a < b") == "a < b"


def test_density_decides_on_pages_without_links():
    long = "<p>" + "A sentence of the article that goes on for a while. " * 6 + "</p>"
    page = f"<body><div>By reading on you accept the terms.</div>{{}}<div><span>All rights</span> <span>reserved</span></div></body>"
    for whole in (f"<article><h1>Title</h1>{long * 4}<p>Short.</p></article>", f"<div><h1>Title</h1>{long * 4}<p>Short.</p></div>", f"<div><h1>Title</h1><p><b>{long[3:-4]}<br></b></p><p>Short.</p></div>"):
        text = html.main_text(page.format(whole))
        assert text.startswith("Title\nA sentence") and text.endswith("\nShort.") and "accept" not in text and "reserved" not in text
        linked = page.format("<nav><a href='/'>Home</a></nav>" + whole)
        assert html.main_text(linked) == text
    nodes = html.order(html.parse(page.format(f"<article>{long}</article>")))
    html.measure(nodes)
    assert all(n.density > 0 for n in nodes if n.chars > 1)


def test_density_against_a_plain_tree():
    """Counts by recursion over each node's own subtree, and the formula written out."""
    rng = random.Random(7)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return "word " * rng.randint(1, 30)
        tag = rng.choice(["div", "p", "a", "section", "span"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    def below(n):
        return [p for p in n.parts if isinstance(p, html.Node)]

    def chars(n):
        return sum(len("".join(p.split())) for p in n.parts if isinstance(p, str)) + sum(map(chars, below(n)))

    def links(n):
        return chars(n) if n.tag == "a" else sum(map(links, below(n)))

    def tags(n, only=""):
        return sum((not only or p.tag == only) + tags(p, only) for p in below(n))

    for _ in range(40):
        root = html.parse("<body>" + "".join(made(4) for _ in range(3)) + "</body>")
        nodes = html.order(root)
        html.measure(nodes)
        share = links(root) / max(1, chars(root))
        for n in nodes:
            c, k, t, kt = chars(n), links(n), tags(n), tags(n, "a")
            ratio = c / max(1, k) * max(1, t) / max(1, kt)
            base = max(math.e, math.log(c / max(1, c - k) * k + share * c + math.e))
            want = c / max(1, t) * (math.log(ratio, base) if ratio > 1 else 0)
            assert (n.chars, n.link_chars, n.tags, n.link_tags) == (c, k, t, kt) and abs(n.density - want) < 1e-9 * max(1, want)
            assert abs(n.total - sum(p.density for p in below(n))) < 1e-9 * max(1, n.total)


def test_marks_on_what_holds_the_text():
    said = "A sentence of the article that goes on for a while. " * 6
    article = f"<article><div class='post-header'><h1>Title</h1></div><p>{said}</p><p>{said}</p><div class='share'>Share this</div></article>"
    want = "\n".join(["Title", said.strip(), said.strip()])
    for tag in ("<div class='content-sidebar-wrap'>", "<div class='has-sidebar'>", "<div class='page no-header'>", "<form action='/'>"):
        close = f"</{tag[1:].split()[0]}>"
        for whole in (article, article.replace("article>", "main>"), article.replace("article>", "div>").replace("post-header", "top")):
            page = f"<body>{tag}{whole}<div class='sidebar'>Other things</div>{close}<div class='ad'>Buy</div></body>"
            assert html.main_text(page) == want
    comments = f"<div id='comments'><article class='comment'><p>{said * 9}</p></article></div><div class='related'><article><p>Teaser</p></article></div>"
    assert html.main_text(f"<body>{article}{comments}</body>") == want
    assert html.main_text(f"<body><div hidden>{article}</div><p>{said}</p></body>") == said.strip()


def test_pages(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, "extra")] * 2 + [(2, None, None, "extra"), (None, "v", "", "extra")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(frame).collect())
    assert got == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0)]
    assert html.extract(frame.limit(0)).count() == 0


WORDS = "A sentence of the article that goes on for a while. "


@pytest.mark.parametrize("names", [("social-science", "related-study"), ("share", "related"), ("widget", "share-links"), ("plain", "widget")])
def test_text_in_two_marked_parts(names):
    halves = [f'<div class="{n}"><p>{WORDS * 5}{k}</p><p>{WORDS * 4}{k}</p></div>' for k, n in enumerate(names)]
    page = f"<html><body><nav><a href='/'>Home</a></nav>{''.join(halves)}</body></html>"
    text = html.main_text(page)
    marked = [n for n in names if n in ("widget",)]
    assert text.count(WORDS.strip()) >= (9 if names == ("plain", "widget") else 18) and "Home" not in text and (marked or text.count("\n") == 3)


def test_names_that_only_hold_a_mark():
    inside = f'<p>{WORDS * 4}</p><div class="share-price">12.50</div><figure class="ad-hoc-chart">A chart.</figure><div class="ad">Buy!</div><div class="share-links">Tell all</div><div id="related-posts">More</div><p>{WORDS * 3}</p>'
    text = html.main_text(f"<html><body><article>{inside}</article></body></html>")
    assert "12.50" in text and "A chart." in text and "Buy!" not in text and "Tell all" not in text and "More" not in text


def plain_choice(root):
    """The selection with recursion over a plain tree, in the words of the method."""
    nodes = html.order(root)
    body = next((n for n in nodes if n.tag == "body"), root)

    def inner(n):
        return [p for p in n.parts if isinstance(p, html.Node) and not p.noise]

    def count(n):
        """Characters, link characters, tags and link tags below n."""
        own = sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        found = [count(p) for p in inner(n)]
        chars = own + sum(f[0] for f in found)
        return chars, chars if n.tag == "a" else sum(f[1] for f in found), sum(f[2] + 1 for f in found), sum(f[3] + (p.tag == "a") for f, p in zip(found, inner(n), strict=True))

    page = count(nodes[0])

    def density(n):
        c, lc, t, lt = count(n)
        base = max(math.e, math.log(c / max(1, c - lc) * lc + page[1] / max(1, page[0]) * c + math.e))
        ratio = c / max(1, lc) * max(1, t) / max(1, lt)
        return c / max(1, t) * (math.log(ratio) / math.log(base) if ratio > 1 else 0.0)

    def total(n):
        return sum(density(p) for p in inner(n))

    below = lambda n: [n, *[x for p in inner(n) for x in below(p)]]
    best = max((n for n in below(body) if n.tag in html.HOLDERS), key=lambda n: (round(total(n), 9), count(n)[0]))
    if total(best) <= 0:
        return {id(body)}
    way = [best]
    while way[-1] is not body:
        way.append(way[-1].up)
    limit, chosen = min(density(n) for n in way), {id(best)}

    def look(n):
        if id(n) in chosen:
            return
        if n not in way and density(n) >= limit - 1e-12 and count(n)[0]:
            chosen.add(id(max((x for x in below(n) if x is n or x.tag in html.HOLDERS), key=lambda x: (round(total(x), 9), x is n))))
            return
        for p in inner(n):
            look(p)

    look(body)
    return chosen


def test_selection_is_that_of_a_plain_tree():
    rng = random.Random(5)

    def element(depth):
        tag = rng.choice(["div", "p", "section", "a", "span", "td", "ul", "li", "article"])
        inside = "".join(element(depth - 1) if depth and rng.random() < 0.6 else " ".join(["word"] * rng.randint(0, 40)) for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inside}</{tag}>"

    for _ in range(150):
        root = html.parse(f"<html><body>{element(4)}{element(3)}<div>tail</div></body></html>")
        assert html.content(root) == plain_choice(root)
