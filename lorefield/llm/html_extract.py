"""Main-text extraction from HTML by boosted trees over DOM nodes, with hierarchical decoding.

A page becomes a tree of its block elements; runs of text beside block children are leaves of their own. Each node has
features of its subtree (text and link density, punctuation, paragraphs), of its and its ancestors' tags and attribute
tokens, of its depth and of its siblings. Boosted trees give each node's chance to be main text. Decoding then picks one of three states for each node, by
dynamic programming over the tree: dropped (and with it everything below), kept (children are kept or dropped), or mixed (a wrapper, whose
children choose freely), so that nothing is kept under something dropped.

Training uses a bounded sample of the table's own pages whose mark-up states the article. Their copies are rewritten by rule: semantic tags become
plain blocks with various class names or none, and menus, notices, adverts, forms, sidebars and comments are put beside and inside
the article. So the trees learn from structure and tokens instead of one tag. Some copies lie in a form as a whole, as pages of some servers do, or in a layout table; some comments
have no name, and in a third of the copies blocks around the article have generated names or none, so that place and structure decide.

Defined results: a null or empty page gives an empty text; a page without main text gives an empty text; whole pages are
read whatever their length or depth; repeated rows give equal texts, ties between states go to keeping; a null id or URL stays null; without any page to learn from, built-in sentences fill the training pages;
an empty table gives an empty result; only the columns named in the result are read, whatever other columns are called.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost
from .hashing import slices

#: Bounds of the training sample: pages, those with the smallest hashes; rewritten copies of each; pages that train at least, made of built-in sentences where the table has fewer; blocks of its article that a copy has at most, drawn by hash; nodes of a copy that train
#: at most; characters of a page that trains at most. All pages are extracted whole.
TRAIN_PAGES = 160
COPIES = 6
LEAST_PAGES = 48
TRAIN_BLOCKS = 40
TRAIN_NODES = 80
TRAIN_CHARS = 1_000_000
#: Share of copies whose article has neither a telling element nor a telling name.
NAMELESS = 0.2
#: Trees, and their depth.
TREES, DEPTH = 120, 4
#: Log odds that dropping something inside kept text has to overcome, the chance that a mixed node counts with, and nodes that are scored at once.
CARVED = 1.5
MIXED = 0.2
SCORED = 4096
#: Buckets of hashed attribute tokens.
HASHED = 24

# Fixed values of HTML: elements inside a line, elements without content, elements never shown as text, and elements that a start tag ends.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas audio video select textarea button datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div article section main aside nav body blockquote form header footer".split())
TAGS = ("article main section div p h blockquote pre ul ol li dl table td nav header footer aside form figure figcaption address #text".split())
# Families of attribute tokens, in several languages.
FAMILIES = {
    "article": "article story post entry hentry blog news artikel beitrag articulo noticia histoire", "content": "content main body text prose copy page inhalt contenu contenido texte", "title": "title headline heading titel titre titulo ueberschrift",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs navigation menue navi hauptmenue sommaire navegacion", "header": "header masthead top topbar logo brand kopf kopfzeile entete cabecera", "footer": "footer foot bottom copyright colophon legal fuss fusszeile pied pie impressum",
    "side": "sidebar side aside widget rail related recommended trending popular archive tags tag seitenleiste randspalte verwandt lateral barra relacionados connexe", "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner werbung anzeige anzeigen publicite publicidad anuncio anuncios pub reklame",
    "notice": "cookie cookies consent notice alert gdpr modal popup overlay warning disclaimer paywall hinweis datenschutz avis aviso banniere zustimmung", "comment": "comment comments reply replies respond discussion disqus feedback thread kommentar kommentare commentaire commentaires comentario comentarios opinion opiniones leserbriefe antworten reponse respuestas",
    "form": "form login signup subscribe newsletter search register contact formular anmeldung suche formulaire recherche formulario busqueda abonnement", "social": "share sharing social follow meta byline author tools teilen partager compartir autor auteur",
}
_FAMILY = {t: i for i, words in enumerate(FAMILIES.values()) for t in words.split()}
_TAG = re.compile(r"<!--|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>")
_ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]+)", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Block nodes in page order: parent, tag, tokens, own text runs. A node's descendants follow it directly."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.attrs, self.text, self.linked = [-1], ["body"], [""], [""], [0]
        self.stack, self.runs, self.hidden = [0], [], 0
        self.link = False
        self.ends: dict[str, tuple[int, int]] = {}
        at, n = 0, len(source)
        hidden: list[str] = []
        while at < n:
            m = _TAG.search(source, at)
            if not hidden:
                self._put(source[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            if m[0] == "<!--":
                end = source.find("-->", at)
                at = n if end < 0 else end + 3
                continue
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if not m[1] and tag in RAW and "svg" not in hidden and "math" not in hidden:  # those two hold mark-up in every element
                start, end = self._end(source, tag, at)
                # in hidden elements one that isn't ended there is scanned as mark-up, so that it doesn't take the page with it
                if not hidden or start < (self._end(source, "noscript", at)[0] if "noscript" in hidden else n):
                    at = end
                    if not hidden and (tag == "textarea" or tag in HIDDEN):
                        self._put(" ")
                    continue
            if hidden:
                if m[1] and tag in hidden:
                    del hidden[hidden.index(tag):]
                elif not m[1] and (tag == hidden[-1] or tag in ("svg", "math", "noscript") and not m[3].endswith("/")):
                    hidden.append(tag)
                elif tag == "body":
                    hidden.clear()
                continue
            if not m[1] and tag in HIDDEN:
                hidden.append(tag)
                self._put(" ")
            elif tag == "a":
                self.link = not m[1]
            elif tag in ("br", "hr", "img", "input"):
                self._put(" ")
            elif tag in INLINE or tag in VOID or tag in ("html", "body"):
                continue
            elif m[1]:
                self._close(tag)
            else:
                self._open(tag, m[3])
        self._flush()

    def _end(self, source: str, tag: str, at: int) -> tuple[int, int]:
        """Start and end of the next end tag of an element, the page's end where there is none; each part of the page is searched once."""
        if tag not in self.ends or self.ends[tag][0] < at:
            m = re.compile(rf"</{tag}\s*+>", re.I).search(source, at)
            self.ends[tag] = m.span() if m else (len(source), len(source))
        return self.ends[tag]

    def _put(self, text: str) -> None:
        if text:
            self.runs.append((text, self.link))

    def _flush(self) -> None:
        """The open run becomes a leaf under the open node."""
        if self.runs:
            raw = "".join(x for x, _ in self.runs)
            if not raw.isspace():
                text = " ".join(entities.unescape(raw).split())
                if text:
                    self.parent.append(self.stack[-1])
                    self.tag.append("#text")
                    self.attrs.append("")
                    self.text.append(text)
                    self.linked.append(sum(len(x.strip()) for x, a in self.runs if a))
            self.runs = []

    def _open(self, tag: str, attrs: str) -> None:
        self._flush()
        self.link = False
        ends = ENDS.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[k]]
            if own == "p" or own in ends:
                del self.stack[k:]
                if own == "p":
                    continue
                break
            if own in SCOPES:
                break
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append("")
        self.linked.append(0)
        self.stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        self._flush()
        self.link = False
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == tag:
                del self.stack[k:]
                return


@functools.lru_cache(4096)
def _tokens(attrs: str) -> int:
    """Families that occur among the attribute tokens, as bits; then the tokens' hashes."""
    out = 0
    for m in _ATTR.finditer(attrs):
        for t in _TOKEN.findall(m[1]):
            if (k := _FAMILY.get(t.lower())) is not None:
                out |= 1 << k
            out |= 1 << len(FAMILIES) + zlib.crc32(t.lower().encode()) % HASHED
    return out


_KIND = {t: 1 << i for i, t in enumerate(TAGS)} | {f"h{i}": 1 << TAGS.index("h") for i in range(1, 7)}


def node_rows(page: Page) -> list[tuple]:
    """For each node: sums over its subtree, its place among its siblings, its parent's sums, and tag and token bits of itself and of its ancestors."""
    n, parent, tags = len(page.tag), page.parent, page.tag
    length, linked = [len(x) for x in page.text], page.linked[:]
    commas = [x.count(",") for x in page.text]
    stops = [x.count(".") + x.count("!") + x.count("?") for x in page.text]
    leaves, paras, nodes = [1 if x else 0 for x in page.text], [1 if t == "p" else 0 for t in tags], [1] * n
    depth, index, children = [0] * n, [0] * n, [0] * n
    own = [0] * n
    alike: dict[tuple[int, str], int] = {}
    for i in range(n):
        attrs = page.attrs[i]
        own[i] = _KIND.get(tags[i], 0) << len(FAMILIES) + HASHED | (_tokens(attrs) if attrs else 0)
        if i:
            p = parent[i]
            depth[i], index[i] = depth[p] + 1, children[p]
            children[p] += 1
            alike[p, tags[i]] = alike.get((p, tags[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        length[p] += length[i]
        linked[p] += linked[i]
        commas[p] += commas[i]
        stops[p] += stops[i]
        leaves[p] += leaves[i]
        paras[p] += paras[i]
        nodes[p] += nodes[i]
    above, form = [0] * n, [length[0]] * n  # form: characters in the nearest form around a node, or else in the page
    for i in range(1, n):
        above[i] = above[parent[i]] | own[parent[i]]
        form[i] = length[i] if tags[i] == "form" else form[parent[i]]
    return [(length[i], linked[i], commas[i], stops[i], leaves[i], paras[i], nodes[i], depth[i], index[i], children[p], alike.get((p, tags[i]), 1),
             length[p], linked[p], paras[p], length[0], form[i], own[i], above[i]) for i, p in enumerate([0, *parent[1:]])]


def node_features(rows: list[tuple]) -> np.ndarray:
    """The features of nodes, from their rows: subtree density, siblings, depth, and indicators of the bits."""
    length, linked, commas, stops, leaves, paras, nodes, depth, index, brothers, same, up_length, up_linked, up_paras, page, form, own, above = np.array(rows, np.int64).reshape(-1, 18).T
    per = lambda a, b: a / np.maximum(b, 1)
    bits = np.arange(len(FAMILIES) + HASHED + len(TAGS))
    families = np.r_[bits[: len(FAMILIES)], bits[len(FAMILIES) + HASHED :]]  # ancestors by family and tag only, and forms by their share of the page instead
    families = families[~np.isin(families, (_FAMILY["form"], len(FAMILIES) + HASHED + TAGS.index("form")))]
    return np.c_[
        np.log1p(length), per(linked, length), per(length, nodes), per(length, leaves), per(commas, length) * 100, per(stops, length) * 100, np.log1p(paras),
        np.log1p(nodes), per(length, page), per(length, up_length), np.minimum(depth, 30), per(index, brothers), np.log1p(brothers), per(same, brothers), np.log1p(up_length),
        per(up_linked, up_length), np.log1p(up_paras), per(form, page), own[:, None] >> bits & 1, above[:, None] >> families & 1].astype(np.float32)


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """Which nodes are kept: the best consistent states. Mixed costs as much as a node of chance MIXED."""
    n = len(page.tag)
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    drop, keep, mixed = no.copy(), yes.copy(), np.full(n, np.log(MIXED))
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "#text":
            mixed[i] = -np.inf
        p = page.parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i] - CARVED)
        mixed[p] += max(keep[i], drop[i], mixed[i])
    kept = [False] * n
    state = ["m"] + [""] * (n - 1)  # the page itself is a wrapper
    for i in range(1, n):
        above = state[page.parent[i]]
        if above == "d":
            state[i] = "d"
        elif above == "k":
            state[i] = "k" if keep[i] >= drop[i] - CARVED else "d"
        else:
            state[i] = max((("k", keep[i]), ("d", drop[i]), ("m", mixed[i])), key=lambda x: x[1])[0]
        kept[i] = state[i] == "k"
    return kept


def main_texts(sources: Iterator[str | None], model: Boosted) -> list[str]:
    """The main text of each page; nodes of several pages are scored at once."""
    out: list[str] = []
    held: list[tuple[Page, list[tuple]]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        logit = model.logit(node_features([r for _, x in held for r in x])) if held else np.empty(0)
        at = 0
        for page, x in held:
            kept = decode(page, logit[at : at + len(x)])
            out.append(" ".join(t for t, k in zip(page.text, kept) if t and k))
            at += len(x)
        held.clear()
        size = 0

    for source in sources:
        page = Page(source or "")
        held.append((page, node_rows(page)))
        size += len(page.tag)
        if size >= SCORED:
            flush()
    flush()
    return out


# ---- training ----

_BOILER = ("nav", "header", "footer", "aside", "form")
_SENTENCES = ("The river rose slowly, and the town kept watch through the night.", "Nobody knew, at first, where the letters had come from.",
              "A short walk leads to the mill, which still stands.", "She read the report twice, then set it aside.")


def _blocks(source: str) -> tuple[list[str], list[str]]:
    """Texts of a page's stated article, and of what lies in stated boilerplate."""
    page = Page(source)
    main, rest = [], []
    state = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        tag, tokens = page.tag[i], _tokens(page.attrs[i])
        bad = tag in _BOILER or tokens >> 3 & (1 << len(FAMILIES) - 3) - 1
        state[i] = -1 if bad or state[page.parent[i]] == -1 else 1 if tag in ("article", "main") or tokens & 1 else state[page.parent[i]]
        if page.text[i] and state[i]:
            (main if state[i] == 1 else rest).append(page.text[i])
    return main, rest


def _drawn(blocks: list[str]) -> list[str]:
    """At most TRAIN_BLOCKS of the blocks, those with the smallest hashes, in their order."""
    least = sorted(range(len(blocks)), key=lambda i: (zlib.crc32(f"{i} {blocks[i]}".encode()), i))[:TRAIN_BLOCKS]
    return [blocks[i] for i in sorted(least)]


def _rewritten(main: list[str], rest: list[str], rng: random.Random) -> str:
    """A page with these texts: nodes of the article carry data-main, so that their labels can be read off again."""
    words = " ".join(rest or main).split() or ["more"]
    some = lambda a, b: entities.escape(" ".join(rng.choice(words) for _ in range(rng.randint(a, b))))
    link = lambda: f'<a href="/x">{some(1, 3)}</a>'
    named = lambda *f: rng.choice(["", f' class="{rng.choice(FAMILIES[rng.choice(f)].split())}"', f' id="{rng.choice(FAMILIES[rng.choice(f)].split())}-{rng.choice(("box", "wrap", "area", "1"))}"',
                                   f' class="{rng.choice(("c1 ", "js-", "site-", "b_"))}{rng.choice(FAMILIES[rng.choice(f)].split())}"'])
    sure = lambda f: f' class="{rng.choice(FAMILIES[f].split())}"'
    plain = rng.random() < 0.35  # the blocks around the article have generated names or none
    made = lambda: rng.choice(("", f' class="{rng.choice(("css-", "sc-", "x", "_"))}{rng.randrange(1 << 20):x}"'))
    outer = lambda f: made() if plain and rng.random() < 0.7 else sure(f)
    parts = lambda t: [x for x in re.findall(r"\S.{0,80}(?:\s|$)", t) if rng.random() < 0.9] or [t]
    items = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b))) + "</ul>"

    def menu() -> str:
        return rng.choice((f"<nav{named('nav')}>{items(3, 9)}</nav>", f"<div{named('nav', 'header')}>{items(3, 9)}</div>", f"<div{outer('nav')}>{' | '.join(link() for _ in range(rng.randint(3, 8)))}</div>"))

    def box(f: str, tags: tuple[str, ...], around: bool) -> str:
        tag = rng.choice(tags)
        own = outer(f) if around else sure(f) if tag in ("div", "section", "ul") else named(f)
        inner = rng.choice((f"<p>{some(3, 30)}</p>", some(3, 30), f"<h3>{some(1, 4)}</h3>{items(2, 6)}", f"<p>{some(2, 12)} {link()}</p>", f"<p>{some(10, 60)}.</p><p>{some(5, 40)}.</p>"))
        return f"<{tag}{own}>{inner}</{tag}>"

    def comments() -> str:
        named_ = rng.random() < 0.8
        one = lambda: f"<{(t := rng.choice(('li', 'div', 'article')))}{rng.choice((sure('comment'), '')) if named_ else ''}><p>{some(1, 3)} {link()}</p><p>{some(4, 60)}.</p></{t}>"
        tag = rng.choice(("section", "div", "ol"))
        return f"<{tag}{sure('comment') if named_ or tag == 'div' else ''}><h{rng.choice('234')}>{some(1, 3)}</h{rng.choice('234')}>{''.join(one() for _ in range(rng.randint(1, 6)))}</{tag}>"

    def form() -> str:
        return rng.choice((f"<form{named('form')}><p>{some(2, 12)}</p><label>{some(1, 3)}</label><input type=text></form>", f"<div{sure('form')}><p>{some(3, 15)}</p><input></div>"))

    def side(around: bool = False) -> str:
        return rng.choice((lambda: box("side", ("aside", "div", "section"), around), lambda: box("ad", ("div", "aside", "section"), around), lambda: box("notice", ("div", "section", "aside"), around),
                           lambda: box("social", ("div", "ul", "section"), around), form, comments))()

    wrap = rng.choice(("article", "article", "main", "section", "div", "div"))
    own = named("article", "content") if wrap in ("article", "main") else rng.choice((named("article", "content"), sure("article"), sure("content")))
    if rng.random() < NAMELESS:
        wrap, own = "div", made()
    body = [f"<h1 data-main>{entities.escape(main[0])}</h1>" if i == 0 and len(main) > 1 and len(t) < 200 else
            rng.choices((f"<p data-main>{entities.escape(t)}</p>", f"<div data-main>{entities.escape(t)}</div>", f"<blockquote data-main><p data-main>{entities.escape(t)}</p></blockquote>", f"<h2 data-main>{some(1, 6)}</h2><p data-main>{entities.escape(t)}</p>",
                         "<ul data-main>" + "".join(f"<li data-main>{entities.escape(x)}</li>" for x in parts(t)) + "</ul>",
                         "<table data-main>" + "".join(f"<tr data-main><td data-main>{entities.escape(x)}</td></tr>" for x in parts(t)) + "</table>"), (12, 1, 1, 2, 1, 1))[0]
            for i, t in enumerate(main)]
    if rng.random() < 0.5:  # a title of a few words
        title = main[0].split()
        title = " ".join(title[(at := rng.randrange(len(title))) : at + rng.randint(1, 8)]) if title else "more"
        body.insert(0, f"<{(h := rng.choice(('h1', 'h1', 'h2')))} data-main>{entities.escape(title)}</{h}>")
    for _ in range(rng.choice((0, 0, 1, 2))):
        body.insert(rng.randint(0, len(body)), side())
    if rng.random() < 0.3:
        body.append(comments())
    article = f"<{wrap}{own} data-main>{''.join(body)}</{wrap}>"
    if rng.random() < 0.4:
        article = f"<div{named('content')}>{article}{''.join(side() for _ in range(rng.randint(0, 2)))}</div>"
    before = [menu() for _ in range(rng.randint(1, 2))] + [side(True) for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.5:
        before.insert(0, rng.choice((f"<header{named('header')}><p>{some(1, 6)}</p>{menu()}</header>", f"<div{outer('header')}>{some(1, 6)}</div>")))
    after = [side(True) for _ in range(rng.randint(0, 3))] + ([comments()] if rng.random() < 0.3 else [])
    foot = rng.choice((f"<footer{named('footer')}>&copy; {some(2, 12)}</footer>", f"<div{outer('footer')}><p>&copy; {some(2, 12)}</p>{items(1, 4)}</div>", f"<div{outer('footer')}>&copy; {some(2, 12)}.</div>", f"<footer><p>{some(3, 20)}.</p></footer>"))
    if rng.random() < 0.08:  # a layout table
        return (f"<table{made()}><tr><td colspan=2>{''.join(before)}</td></tr><tr><td>{items(2, 8)}</td><td data-main>{''.join(body)}</td></tr>"
                f"<tr><td colspan=2>{rng.choice((foot, f'&copy; {some(2, 12)}'))}</td></tr></table>")
    page = "".join([*before, article, *after, foot])
    return f'<form{rng.choice((named("form"), named("content"), ""))} method="post">{page}</form>' if rng.random() < 0.2 else page


def _labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a rewritten page; wrappers above the article have no label."""
    page = Page(source)
    n = len(page.tag)
    main = np.array(["data-main" in a for a in page.attrs])
    label = np.where(main, 1, 0)
    for i in range(1, n):
        if page.tag[i] == "#text":
            label[i] = label[page.parent[i]]
    holds = main.copy()
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    use = ~(holds & ~main)
    use[0] = False
    return node_features(node_rows(page))[use], label[use]


def trained(pages: DataFrame, html_col: str = "html", max_pages: int = TRAIN_PAGES) -> Boosted:
    """Trees from max_pages pages, those with the smallest hashes, rewritten COPIES times each."""
    n = pages.count()
    place = F.pmod(F.xxhash64(html_col), F.lit(1 << 30))
    drawn = (pages.where((place < F.lit(2 * (max_pages + 100) / max(1, n) * (1 << 30))) & (F.length(html_col) <= TRAIN_CHARS)).select(F.col(html_col).alias("html"), place.alias("place"))
             .distinct().orderBy("place", "html").limit(max_pages))
    return _fitted(sorted(r["html"] for r in drawn.toLocalIterator()))


def _fitted(sources: list[str]) -> Boosted:
    """Trees from these pages' copies."""
    found = [(_drawn(m), r) for m, r in map(_blocks, sources) if m]
    rng = random.Random(7)
    while len(found) < LEAST_PAGES:
        found.append(([" ".join(rng.choice(_SENTENCES) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(2, 12))], list(_SENTENCES)))
    xs, ys = [], []
    for main, rest in found:
        for _ in range(COPIES):
            x, y = _labelled(_rewritten(main, rest, rng))
            pick = rng.sample(range(len(y)), min(len(y), TRAIN_NODES))
            xs.append(x[pick])
            ys.append(y[pick])
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float), TREES, DEPTH)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (main text, empty if none), n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(trained(pages, html_col))
    id_type = pages.schema[id_col].dataType.simpleString()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2), 4 << 20):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main_texts(iter(part.column(2).to_pylist()), held.value), pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(extracted, f"id {id_type}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
