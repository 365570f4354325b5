import math
import re
import time

import pytest

from refloom.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html lang=en><head><title>No</title><style>p{a:"</p>"}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header class=top><h2>Site name</h2></header><nav><ul><li><a href=/x>Menu</a><li><a href=/y>More</a></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy now, please, now.</div><div id="cookie-notice"><p>We use cookies, many, many.</p></div>
%s
<aside><p>Read also, this, and that, and more of the same, again.</p></aside><form><p>Subscribe, today, now</p><input name=a></form>
<section class="comments"><h3>Comments</h3><p>First, I say, of all, this is great, really, great.</p></section>
<footer>&copy; Someone, somewhere</footer></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><h1>Title &amp; more</h1><p><b>Lead.<br><p>One,  two\n three &lt;b&gt; &eacute;.</p><p>Last</article>", ["Title & more", "Lead.", "One, two three <b> é.", "Last"]),
    ("<div class=post><h1>Title</h1><div><p>Some text, quite long, with commas, and so on.</p><ul><li>An item<li>Other, item</ul><pre> a\n  b </pre></div></div>", ["Title", "Some text, quite long, with commas, and so on.", "An item", "Other, item", "a b"]),
    ("<main><section><h2>A</h2><p>x</p></section><section><h2>B</h2><p>Long, long, long text, with <a href=q>a link</a>, in it.</p></section></main>", ["A", "x", "B", "Long, long, long text, with a link, in it."]),
    ("<article><p>Text, and a quote's end <a title=it's href='>'>here</a>.<blockquote>Quoted</blockquote><table><tr><td>1<td>2<tr><td>3</table><article class='comment'><p>Nice, very, very nice.</p></article></article>", ["Text, and a quote's end here.", "Quoted", "1", "2", "3"]),
])
def test_pages(body, want):
    assert main_text(PAGE % body) == "\n\n".join(want)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<!-- x") == ""
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<p>one<p>two</div></p></b> three") == "one\n\ntwo\n\nthree"
    deep = "<div>" * 5000 + "<p>deep, text</p>"
    assert main_text(deep) == "deep, text"
    began = time.time()
    for bad in ("<a " + 'x="' * 50000, "<" * 100000, "<a b='" * 30000, "<!--" * 30000, "<script>" * 20000, "&" * 100000):
        main_text(bad)
    assert time.time() - began < 20
    long = "<article>" + "".join(f"<p>Para {i}, text.</p>" for i in range(20000)) + "</article>"
    assert main_text(long).count("\n\n") == 19999


def test_table(spark):
    rows = [(1, "u", PAGE % "<article><p>Hello, there</p></article>", 1), (1, "u", None, 1), (None, None, "", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "Hello, there", 12), (1, "u", "", 0), (None, None, "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0


def test_against_the_article_of_generated_pages(spark):
    """The test pages mark their article; a plain cut of it must give the same text."""
    import html

    for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


TEXT = ["The first paragraph of it, with commas, goes on for a while and says something.", "A second, which is longer, and which has, as one sees, a few commas more than the first had.", "And a third one, to end with."]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)


@pytest.mark.parametrize("page", [
    '<body><div class="content with-sidebar">%s</div></body>', '<body><div class="page-no-header"><div>%s</div></div></body>', '<body><div class="market-share report">%s</div></body>',
    '<body><form id="aspnetForm" method=post><div>%s</div><input type=submit></form></body>', '<body><div class="sidebar">%s</div></body>', '<div class="share"><div class="notice">%s</div></div>',
    '<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><div id="modal-root" style="display:none"><div>%s</div></div><footer>The end, of it</footer></body>',
    '<body><div class="related">%s</div><div class="ad">Buy, now</div><aside><p>Short, this.</p></aside></body>',
])
def test_hints_cannot_empty_a_page(page):
    assert main_text(page % BODY) == "\n\n".join(TEXT)


@pytest.mark.parametrize("inner, want", [
    ("<ul><li><a href=a>One source</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>", ["One source", "Two", "Three"]),
    ("<p><math><mi>x</mi><mo>=</mo><mn>2</mn></math></p>", ["x=2"]), ("<p><svg><text>Axis</text></svg></p>", ["Axis"]), ("<p><object>Plan</object></p>", ["Plan"]),
    ("<p><a href=x>All of this is a link</a></p>", ["All of this is a link"]), ('<p class="no-ads">Here</p>', ["Here"]),
    ('<nav><a href=x>Contents</a></nav><div class="adBox">Buy</div><div class="commentList"><p>Nice, very, very nice.</p></div><p>After</p>', ["After"]),
])
@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<body><div>%s</div></body>"])
def test_inside_the_article(inner, want, around):
    assert main_text(around % (BODY + inner + "<p>Last, of all, it ends.</p>")) == "\n\n".join([*TEXT, *want, "Last, of all, it ends."])


def test_linked_text_alone():
    assert main_text("<div><a href=x>Only a link</a></div>") == "Only a link"
    assert main_text("<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>") == "One\n\nTwo"
    assert main_text("<p>Same, a</p>" * 2) == "Same, a\n\nSame, a"  # ties and repeats


def unnamed_page(rng):
    """A page whose tags and classes tell nothing: what is the article, scores must find."""
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy".split()
    say = lambda n: " ".join(rng.choice(words) + ("," if rng.random() < 0.12 else "") for _ in range(n)).strip(",").capitalize() + "."
    links = lambda n: "".join(f'<div><a href="/{i}">{rng.choice(words)} {rng.choice(words)}</a></div>' for i in range(n))
    paras = [say(rng.randint(15, 60)) for _ in range(rng.randint(3, 9))]
    title = say(5)
    article = f"<h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in paras)
    menu = f"<div>{links(rng.randint(3, 9))}</div>"
    teasers = "<div>" + "".join(f'<div><a href="/{i}">{say(8)}</a></div>' for i in range(rng.randint(2, 6))) + "</div>"
    foot = f'<div><div><a href="/about">About</a> <a href="/terms">Terms</a> <a href="/privacy">Privacy</a> 2024</div></div>'
    parts = [f'<div id="z{i}">{p}</div>' for i, p in enumerate([article, teasers])]
    if rng.random() < 0.5:
        parts.reverse()
    return f"<html><body>{menu}<div>{''.join(parts)}</div>{foot}</body></html>", [title, *paras]


def test_scores_decide_on_pages_without_telling_names():
    import random

    from refloom.llm import html_text as H

    rng = random.Random(4)
    pages = [unnamed_page(rng) for _ in range(200)]
    assert all(main_text(p) == "\n\n".join(want) for p, want in pages)
    # without scores, all blocks being kept, none of them is right
    assert not any("\n\n".join(b[1] for b in H._Tree(p).blocks) == "\n\n".join(want) for p, want in pages)


def test_scores_by_definition():
    """Points, block by block and ancestor by ancestor, against the scorer."""
    import random

    from refloom.llm import html_text as H

    rng = random.Random(8)
    for _ in range(60):
        page = ""
        for _ in range(40):
            pick = rng.random()
            if pick < 0.35:
                page += rng.choice(["<div>", "<section>", "<div class=sidebar>", "<aside>", "<h2>", "<ul>", "<table><tr><td>"])
            elif pick < 0.5:
                page += rng.choice(["</div>", "</section>", "</aside>", "</h2>", "</ul>", "</table>"])
            else:
                page += rng.choice(["<p>", ""]) + rng.choice(["One, two, three", "x" * 150, "<a href=q>linked, text</a> more", "<a href=q>all</a>", "word"]) + rng.choice(["</p>", "", "<hr>"])
        t = H._Tree(page)
        s = H._Scores(t)
        for i in range(len(t.tag)):
            points = size = linked = 0
            for node, text, inside, _ in t.blocks:
                path = [node]
                while path[-1]:
                    path.append(t.parent[path[-1]])
                if i not in path:
                    continue
                size, linked = size + len(text), linked + inside
                to = path if t.tag[node] in H.CONTAINERS else path[1:]
                if i in to:
                    gain = (1 + text.count(",") + min(len(text) / 100, 3)) * max(1 - inside / len(text), H.LEAST)
                    gain *= (0.25 if t.tag[node] in H.HEADINGS else 1) * math.prod(H.LOWERED[t.hint[k]] for k in path)
                    points += gain / (1 + to.index(i))
            want = points * max(1 - linked / size, H.LEAST) if size else 0
            assert abs(s.score[i] - want) < 1e-9
        if t.blocks:
            assert s.best == s.score.index(max(s.score))
