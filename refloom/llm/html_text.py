"""Main text of web pages by tree scoring.

A page's tags make a tree of its blocks; inline tags leave no trace but the share of
text inside links and the number of links. Each block of text passes points (one, one
for each comma, one for every hundred characters up to three, times the share outside
links) to its parent, half to the next ancestor and a third, a quarter, ... to those
above. The container with the most points, discounted by its link density, is the
article (of equal ones the first), widened to an enclosing article element or, without
one, main element.

Elements, roles and words of class or id that tell of menus, headers, footers, sidebars,
notices, adverts, forms and comments are hints: a hint lowers the points of the blocks
inside to a twentieth, a weak one (a word that has other uses) to a fifth, and what bears
it goes from the article unless it holds the best container. A weak hint also gives way
where its element has a third of the article's points, mostly outside links; words beside
no, with, has, without or free hint at nothing. So hints choose between containers but can't empty a
page. Only what is never text goes at once: scripts, styles, templates, the head,
replaced elements and the controls of forms.

Beside a chosen container its siblings stay if they are headings or paragraphs mostly
outside links, or have a fifth of its points, or are sections or have its class, and are
not hinted at. In an article or main element everything without a hint is kept; in a
container that is neither, menus before its first and behind its last text (two links or
more, over 80 % of the text in them, not under a heading) go. Lists of links, formulas
and linked text inside an article stay.

Null and empty html and pages without text give the empty text; if all text is linked,
the container with most of it is the article. Long pages are read whole, repeated rows
give repeated results, an empty table none, and columns other than page_id, url and html
are not read. Broken markup is read as browsers do in the cases that matter here
(unclosed paragraphs and items, tags that are never closed, stray end tags and quotes).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|select|canvas|audio|video)\b(?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""",
    re.S | re.I,
)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address center fieldset details summary hgroup search nav header footer aside form menu dialog button label legend head".split())
CLOSES_P = BLOCK - {"button", "label", "legend", "html", "body", "head"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
NEVER = frozenset("head button label legend".split())
HINT_TAGS = frozenset("nav footer aside form menu dialog search".split())
HINT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adbox sponsor sponsored comment comments commentlist disqus reply replies respond cookie cookies consent gdpr breadcrumb breadcrumbs newsletter".split())
WEAK = frozenset("sponsors promo promotion banner sidebar sidebars rail nav navbar navigation menu menus footer masthead topbar toolbar notice notices alert popup modal overlay dialog subscribe subscription signup login share sharing social related recommended recommendations trending widget widgets pagination pager skip hidden".split())
NOT = frozenset("no not with without has have free market".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WIDE = frozenset(("article", "main"))
CONTAINERS = frozenset(("", "html", "body", "main", "article", "section", "div", "td", "form"))
NONE, SOME, SURE, TEXTLESS = range(4)
LOWERED = (1.0, 0.2, 0.05, 1.0)  # by hint
LEAST = 1e-6


def _hint(tag: str, attrs: str, inside_article: bool) -> tuple[int, str]:
    """How surely a tag tells of something beside the article; and its class."""
    if tag in NEVER:
        return TEXTLESS, ""
    found = SURE if tag in HINT_TAGS or tag == "header" and not inside_article else NONE
    if not attrs or tag in ("html", "body", "main"):
        return found, ""
    kind = ""
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if name == "class":
                kind = value
            for token in value.split():
                words = {w.lower() for w in WORDS.findall(token)}
                if not words.isdisjoint(NOT):
                    continue
                if not words.isdisjoint(STRONG):
                    found = SURE
                elif tag != "article" and (not words.isdisjoint(WEAK) or "header" in words and not inside_article):
                    found = max(found, SOME)
        elif name == "role" and value.lower() in HINT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            found = SURE
        elif name == "style" and "display:none" in value.lower().replace(" ", ""):
            found = SURE
    return found, kind


class _Tree:
    """Blocks of text (node, text, characters in links, links) and the nodes above them,
    with their hints and classes."""

    def __init__(self, page: str):
        self.parent, self.tag, self.hint, self.kind, self.blocks = [-1], [""], [NONE], [""], []
        stack, junk = [0], 0  # junk: depth of the stack at which dropping began
        parts: list[str] = []
        linked = link = links = articles = 0
        at = 0

        def flush():
            nonlocal linked, links
            if parts:
                text = "".join(parts)
                text = " ".join(text.split())
                parts.clear()
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text)), links))
                linked = links = 0

        def close(depth: int):
            nonlocal junk, articles, link
            flush()
            for node in stack[depth:]:
                articles -= self.tag[node] == "article"
            del stack[depth:]
            link = 0
            if junk and len(stack) < junk:
                junk = 0

        for m in TOKEN.finditer(page, 0, page.rfind(">") + 1):  # behind it no tag can end
            if m.start() > at and not junk:
                s = page[at : m.start()]
                if "&" in s:
                    s = html.unescape(s)
                parts.append(s)
                if link:
                    linked += len(s.strip())
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name not in BLOCK:
                if name == "a":
                    link = 0 if m[2] else 1
                    links += link
                elif name == "br" or name == "hr":
                    if not junk:
                        parts.append(" ")
                        if name == "hr":
                            flush()
                continue
            if m[2]:  # an end tag closes the nearest such element, if any is open
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[i]]
                    if tag == name:
                        close(i)
                        break
                    if tag in WIDE and name not in ("body", "html", "main", "article"):
                        break
                else:
                    flush()
                continue
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[i]]
                    if tag == "p" or tag in HEADINGS and name in HEADINGS:
                        close(i)
                        break
                    if tag != "label":
                        break
            if name in CLOSES:
                what, until = CLOSES[name]
                depth = 0
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[i]]
                    if tag in until:
                        break
                    if tag in what:
                        depth = i
                if depth:
                    close(depth)
            if name == "body":  # closes an open head
                for i in range(1, len(stack)):
                    if self.tag[stack[i]] == "head":
                        close(i)
                        break
            flush()
            self.parent.append(stack[-1])
            self.tag.append(name)
            stack.append(len(self.tag) - 1)
            link = 0
            hint, kind = _hint(name, m[4], articles > 0)
            self.hint.append(hint)
            self.kind.append(kind)
            if not junk and hint == TEXTLESS:
                junk = len(stack)
            articles += name == "article"
        if not junk and at < len(page):
            s = html.unescape(page[at:])
            # a tag that never ends is no text
            parts.append(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", s) if "<" in page[at:] else s)
            if link:
                linked += len(s.strip())
        flush()


def _share(linked: int, size: int) -> float:
    """The share outside links; of linked text as good as nothing, but not nothing."""
    return max(1 - linked / size, LEAST)


class _Scores:
    """Points of a tree's nodes and the discounted ones, sizes, linked characters and
    links of what they hold."""

    def __init__(self, t: _Tree):
        n = len(t.tag)
        self.points, self.plain, self.size, self.linked, self.links = [0.0] * n, [0.0] * n, [0] * n, [0] * n, [0] * n
        lowered = [1.0] * n
        for i in range(1, n):  # parents come first
            lowered[i] = lowered[t.parent[i]] * LOWERED[t.hint[i]]
        for node, text, inside, links in t.blocks:
            gain = (1 + text.count(",") + min(len(text) / 100, 3)) * _share(inside, len(text))
            if t.tag[node] in HEADINGS:
                gain *= 0.25
            # text straight in a container counts for it; a paragraph's counts for its parent
            up = node if t.tag[node] in CONTAINERS else t.parent[node]
            k = 1
            while up >= 0:
                self.points[up] += gain * lowered[node] / k
                up, k = t.parent[up], k + 1
            self.plain[node] += gain
            self.size[node] += len(text)
            self.linked[node] += inside
            self.links[node] += links
        for i in range(n - 1, 0, -1):
            for sums in (self.plain, self.size, self.linked, self.links):
                sums[t.parent[i]] += sums[i]
        self.score = [p * _share(x, z) if z else 0.0 for p, x, z in zip(self.points, self.linked, self.size)]
        self.best = max(range(n), key=lambda i: (self.score[i], -i))

    def text(self, i: int) -> bool:
        """Whether what node i holds is mostly outside links."""
        return self.linked[i] <= 0.5 * self.size[i]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by two line breaks."""
    if not page:
        return ""
    t = _Tree(page)
    if not t.blocks:
        return ""
    s, n = _Scores(t), len(t.tag)
    above = [s.best]  # the best container and those around it, which no hint removes
    while t.parent[above[-1]] >= 0:
        above.append(t.parent[above[-1]])
    around = [[i for i in above if t.tag[i] == kind] for kind in ("article", "main")]
    chosen = next((found[-1] for found in around if found), s.best)
    safe = set(above)
    gone = set()
    for i in range(1, n):
        if t.hint[i] and i not in safe and not (t.hint[i] == SOME and s.plain[i] >= s.plain[chosen] / 3 and s.text(i)):
            gone.add(i)
    keep = {chosen}
    beside = [i for i in range(1, n) if t.parent[i] == t.parent[chosen] and i != chosen and i not in gone and s.size[i]] if chosen else []
    if t.tag[chosen] in WIDE:
        if not any(t.tag[i] == "h1" and t.parent[i] >= 0 and _under(t, i, chosen) for i in range(1, n)):
            keep.update(i for i in beside if t.tag[i] == "h1" and i < chosen)
    else:
        for i in beside:
            like = s.points[i] >= 0.2 * s.points[chosen] or t.tag[i] == t.tag[chosen] == "section" or t.kind[i] and t.kind[i] == t.kind[chosen]
            if t.tag[i] in HEADINGS or s.text(i) and (t.tag[i] not in CONTAINERS or like):
                keep.add(i)
        own = [i for i in range(1, n) if t.parent[i] == chosen and s.size[i]]
        real = [i for i in own if s.text(i) and i not in gone] or own
        for k, i in enumerate(own):
            headed = k and t.tag[own[k - 1]] in HEADINGS
            if not real[0] <= i <= real[-1] and s.links[i] > 1 and s.linked[i] > 0.8 * s.size[i] and not headed and i not in safe:
                gone.add(i)
    state = [False] * n
    for i in range(n):
        state[i] = i not in gone and (i in keep or i > 0 and state[t.parent[i]])
    # text straight in the parent of a chosen container is beside it, too
    loose = t.parent[chosen] if chosen and t.tag[chosen] not in WIDE else -1
    return "\n\n".join(text for node, text, inside, _ in t.blocks if state[node] or node == loose and inside <= 0.5 * len(text))


def _under(t: _Tree, i: int, top: int) -> bool:
    while i > top:
        i = t.parent[i]
    return i == top


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return C.arrow_map(C.doc_columns(pages, "page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
