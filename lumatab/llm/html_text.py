"""Main text of web pages by boosted trees over DOM nodes (operator 8).

Every block-level element is a node with features of its subtree (text, link, sentence and tag density), its
attribute tokens and those above it, depth and position, and its siblings. Boosted trees give each node the
log odds of being main text. Decoding is hierarchical: a node is undecided, main text, or left out; inside a
node left out everything is left out, inside main text a node may be left out, and the assignment with the
largest sum of log odds is found from the leaves up, so that no choice contradicts one above it.

No labelled pages exist, so the trees are trained on pages from a seeded generator below: layouts, attribute
names, missing and unclosed tags are drawn at random, the words are random syllables. The model depends on
nothing in the input; it is trained once a session and sent to the executors (some 100 KB).

Defined cases: a null or empty page, or one without main text, has the empty text; text directly under the page
belongs to its body, implied where there is none, and is chosen with it; pages of any length and
nesting are read in one pass without recursion, in time proportional to their length; only text that is never shown
as the page's is silent before the trees see it (scripts, styles, titles, text areas and choices of forms, templates, frames,
hidden elements); repeated rows are read one by one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatab.llm.dom import Page, read
from lumatab.llm.trees import Boosted, boost

#: Attribute tokens by what they usually name.
TOKENS = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promoted promotion outbrain taboola doubleclick",
    "menu": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumb crumbs topbar toolbar tabs toc skip skiplink sitemap dropdown",
    "head": "header masthead branding logo hero sitename tagline top",
    "foot": "footer foot bottom copyright colophon legal credits imprint contentinfo",
    "side": "sidebar side aside rail widget widgets complementary secondary right left column",
    "notice": "cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay toast announcement disclaimer dialog paywall message messages banner",
    "form": "form forms login signin signup register search searchbox subscribe subscription newsletter contact input mailing optin",
    "comment": "comment comments commentlist commentary reply replies respond discussion disqus thread feedback reviews responses",
    "share": "share sharing social follow facebook twitter tweet like likes buttons print email rss",
    "related": "related recommended recommendations recommend more popular trending latest recent also similar readmore next prev previous pagination pager archive teaser teasers cards",
    "meta": "meta byline author bio date time timestamp published tags tag tagcloud category categories info dateline posted",
    "main": "article articles content contents entry post posts story main body text page blog blogpost articlebody textbody prose hentry richtext copy read reading markdown",
}
_TOKEN_OF: dict[str, int] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        _TOKEN_OF[_w] = _TOKEN_OF.get(_w, 0) | 1 << _i
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A block that begins like this names what stands around it.
_OPENINGS = re.compile(
    r"\W*(?:(?P<comment>\d*\s*(?:comments?|replies|responses|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?))|(?P<related>related|read (?:more|next|also)|you (?:may|might)|more from|recommended|popular|trending|latest)"
    r"|(?P<share>share|follow us|tweet)|(?P<form>subscribe|sign up|newsletter|log ?in|search|e-?mail)|(?P<notice>(?:we|this site) uses? cookies|cookies?|accept|by continuing)|(?P<advert>advert\w*|sponsored|promoted|anzeige|publicit[ée]|publicidad)"
    r"|(?P<foot>©|\(c\)|copyright|all rights reserved))\b|\W*©",
    re.I,
)
_GROUPS = ("article", "main", "section", "div", "p", "heading", "li", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "pre", "figure", "other")
_GROUP_OF = {
    **{t: t for t in ("article", "main", "section", "div", "p", "li", "nav", "header", "footer", "aside", "form", "pre")},
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "heading"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), "dt": "li", "dd": "li",
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), "table"), "blockquote": "quote", "figure": "figure", "figcaption": "figure", "fieldset": "form",
}
_GROUP = {t: _GROUPS.index(g) for t, g in _GROUP_OF.items()}
_ENDS = re.compile(r"[.!?…。！？](?:\s|$)")
N_FEATURES = 44 + len(TOKENS) * 2


@cache
def _tokens(names: str) -> int:
    bits = 0
    for w in _SPLIT.split(_CAMEL.sub(" ", names).lower()):
        bits |= _TOKEN_OF.get(w, 0)
    return bits


def features(page: Page) -> np.ndarray:
    """(nodes, N_FEATURES)."""
    n = len(page.tag)
    parent = page.parent
    own_chars, own_words, own_ends, own_blocks, own_commas = ([0] * n for _ in range(5))
    first_text: list[str | None] = [None] * n
    begin = [-1] * n
    upto = 0
    for node, text in page.blocks:
        own_chars[node] += len(text)
        own_words[node] += text.count(" ") + 1
        own_ends[node] += len(_ENDS.findall(text))
        own_commas[node] += text.count(",")
        own_blocks[node] += 1
        if first_text[node] is None:
            first_text[node], begin[node] = text, upto
        upto += len(text)
    chars, words, ends, blocks, commas = own_chars[:], own_words[:], own_ends[:], own_blocks[:], own_commas[:]
    links, tags, nodes, paragraphs, items = page.links[:], page.tags[:], [1] * n, [0] * n, [0] * n
    kids, depth, order, bits, above, opened = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i], order[i] = depth[p] + 1, kids[p]
        kids[p] += 1
        bits[i] = _tokens(page.names[i]) if page.names[i] else 0
        above[i] = above[p] | bits[p]
        same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        words[p] += words[i]
        ends[p] += ends[i]
        blocks[p] += blocks[i]
        commas[p] += commas[i]
        links[p] += links[i]
        tags[p] += tags[i]
        nodes[p] += nodes[i]
        paragraphs[p] += paragraphs[i] + (page.tag[i] == "p")
        items[p] += items[i] + (page.tag[i] == "li")
        if first_text[i] is not None and (begin[p] < 0 or begin[i] < begin[p]):
            begin[p], first_text[p] = begin[i], first_text[i]
    known = {-1: -1}  # of each text that a node begins with, by where it begins
    for i in range(n):
        if begin[i] not in known:
            m = _OPENINGS.match(first_text[i])
            known[begin[i]] = -1 if m is None else next((j for j, k in enumerate(("comment", "related", "share", "form", "notice", "advert", "foot")) if m[k]), 6)
        opened[i] = known[begin[i]]
    par = np.array(parent)
    par[0] = 0
    f = lambda x: np.array(x, np.float64)
    chars, words, ends, blocks, commas, links, tags, nodes = map(f, (chars, words, ends, blocks, commas, links, tags, nodes))
    own, kid, dep = f(own_chars), f(kids), f(depth)
    group = np.array([_GROUP.get(t, len(_GROUPS) - 1) for t in page.tag])
    siblings = kid[par]
    alike = f([1, *(same[parent[i], page.tag[i]] for i in range(1, n))])
    total = max(1.0, chars[0])
    safe = np.maximum(chars, 1)
    bit, up = np.array(bits), np.array(above)
    level = np.array([ord(t[1]) - 48 if len(t) == 2 and t[0] == "h" and t[1].isdigit() else 0 for t in page.tag])
    in_group = np.zeros((n, 6))  # whether inside a list, nav, header, footer, aside, form
    in_main = np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        in_group[i] = in_group[p]
        in_main[i] = in_main[p] or page.tag[p] in ("article", "main")
        g = _GROUPS[group[p]]
        if g in ("list", "nav", "header", "footer", "aside", "form"):
            in_group[i, ("list", "nav", "header", "footer", "aside", "form").index(g)] = 1
    sibling_mean = (chars[par] - chars - own[par]) / np.maximum(siblings - 1, 1)
    columns = [
        group, np.where(np.arange(n) > 0, group[par], -1), level, dep, np.log1p(chars), np.log1p(words), chars / total, links / safe, tags / safe, nodes / safe,
        ends / np.maximum(words, 1), commas / np.maximum(words, 1), chars / np.maximum(blocks, 1), blocks, f(paragraphs), f(items), kid, f(order) / np.maximum(siblings, 1), siblings, alike / np.maximum(siblings, 1),
        sibling_mean, np.log1p(sibling_mean) - np.log1p(chars), f(begin) / total, own / safe, (links / safe)[par], np.log1p(chars[par]), f(opened), f(opened)[par], in_main, *in_group.T,
        (f(begin) + chars) / total, words / np.maximum(blocks, 1), (ends / np.maximum(words, 1))[par], f(paragraphs)[par], (chars / total)[par], f(items)[par], f([t == "" for t in page.names]), np.minimum(np.arange(n), 50), f(order),
    ]
    for k in range(len(TOKENS)):
        columns += [(bit >> k & 1).astype(float), (up >> k & 1).astype(float)]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the consistent assignment with the largest sum of log odds.

    States: undecided (scores nothing, may only be below undecided), main (+odds, below undecided or main),
    out (-odds, below any; all below it are out). Ties go to the state named first.
    """
    n = len(parent)
    main, out, open_ = odds.tolist(), (-odds).tolist(), [0.0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        out[p] += out[i]
        main[p] += max(main[i], out[i])
        open_[p] += max(open_[i], main[i], out[i])
    state = [0] * n  # 0 undecided, 1 main, 2 out
    for i in range(1, n):
        above = state[parent[i]]
        if above == 2 or out[i] > (main[i] if above == 1 else max(open_[i], main[i])):
            state[i] = 2
        elif above == 1 or main[i] > open_[i]:
            state[i] = 1
    return np.array(state) == 1


def main_text(page: Page, odds: np.ndarray) -> str:
    keep = decode(page.parent, odds)
    return "\n\n".join(text for node, text in page.blocks if keep[node])


# --- pages to learn from -------------------------------------------------------------------------------------


class _Maker:
    """Pages with data-y="1" on main text and data-y="0" on everything else."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choices("abcdefghilmnoprstuvéüñ", k=self.r.randint(2, 4))) for _ in range(60)]

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(self.syllables, k=self.r.randint(1, 3))) for _ in range(self.r.randint(low, high)))

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(1, 22).capitalize().replace(" ", ", " if self.r.random() < 0.3 else " ", 1) + self.r.choice(".....!?") for _ in range(sentences))

    def attr(self, names: str, sure: float = 0.75) -> str:
        """A class or id from the names, a random one, or none."""
        x = self.r.random()
        if x < sure:
            name = self.r.choice(names.split())
            if self.r.random() < 0.3:
                name = self.r.choice(["site-", "page-", "main-", "js-", "c-", "the"]) + name if self.r.random() < 0.5 else name + self.r.choice(["-wrap", "-box", "_inner", "-1", "Block", "-container"])
            return f' {self.r.choice(["class", "id", "class"])}="{name}"'
        return f' class="{self.r.choice(["css-", "x", "sc-"])}{self.r.randrange(10**5)}"' if x < sure + 0.1 else ""

    def links(self, low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{self.words(1, 4)}</a></{tag}>' for i in range(self.r.randint(low, high)))

    def inline(self, text: str) -> str:
        r, words = self.r, text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(words))
            t = r.choice(["b", "em", "strong", "a", "i", "span"])
            words[i] = f'<a href="/x">{words[i]}</a>' if t == "a" else f"<{t}>{words[i]}</{t}>"
        if r.random() < 0.08:
            words[0] = "<b>" + words[0]  # never closed
        if r.random() < 0.1:
            words.insert(r.randrange(len(words)), "<br>")
        return " ".join(words)

    def body(self) -> str:
        """Blocks of an article; now and then one begins like something else, and is still part of it."""
        r, out = self.r, []
        odd = r.random() < 0.2
        lead = lambda: r.choice(["All rights reserved.", "Copyright of", "Read more", "Comments", "Search", "Subscribe", "Cookies", "Related", "Share", "Advertisement", "Sponsored by", "Follow us"]) + " " if odd and r.random() < 0.35 else ""
        if r.random() < 0.85:
            out.append(f"<h1>{(lead() + self.words(0 if odd else 2, 14)).strip()}{r.choice(['', '', '.'])}</h1>")
        n = r.choice([1, 1, 2, 3, 4, 6, 9, 14])
        p = r.choice(["p", "p", "p", "p", "div"])
        for _ in range(n):
            x = r.random()
            if x < 0.8:
                text = lead() + self.inline(self.prose(r.choice([1, 1, 2, 4, 8, 15])))
                if odd and r.random() < 0.15:
                    text = lead() or text
                out.append(f"<{p}>{text}" + (f"</{p}>" if p == "div" or r.random() < 0.9 else ""))
            elif x < 0.86:
                out.append(f"<h{r.choice('2234')}>{self.words(1, 8)}</h2>".replace("</h2>", "") + "</h2></h3></h4>")
            elif x < 0.9:
                kind = r.choice(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{self.inline(self.prose(1))}</li>" for _ in range(r.randint(2, 7))) + f"</{kind}>")
            elif x < 0.93:
                out.append(f"<blockquote>{r.choice(['<p>', ''])}{self.prose(2)}</blockquote>")
            elif x < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.97:
                out.append(f"<figure><img src=x><figcaption>{self.prose(1)}</figcaption></figure>")
            else:
                out.append(f"<pre>{self.words(5, 30)}</pre>")
            if r.random() < 0.05:
                out.append(self.insert())
        return "".join(out)

    def box(self, inner: str, names: str, tags: str = "div div section", sure: float = 0.75) -> str:
        t = self.r.choice(tags.split())
        return f'<{t} data-y="0"{self.attr(names, sure)}>{inner}</{t}>'

    def insert(self) -> str:
        """What may stand inside or beside an article and is not part of it."""
        r = self.r
        kind = r.choice(["ad", "ad", "ad", "share", "related", "notice", "form", "comments", "aside", "meta"])
        if kind == "ad":
            label = r.choice(["", "", "", "<span>Advertisement</span> "])
            return self.box(label + r.choice([self.prose(1), self.prose(r.randint(1, 3)), f"<a href=/buy>{self.words(2, 8)}</a>", f"<p>{self.prose(r.randint(1, 2))}</p>"]), TOKENS["advert"], "div div div aside section", 0.9)
        if kind == "share":
            return self.box(r.choice(["Share: ", ""]) + self.links(2, 5, r.choice(["li", "span"])), TOKENS["share"], "div ul")
        if kind == "related":
            inner = r.choice([f"<ul>{self.links(2, 6)}</ul>", "".join(f"<div><h4><a href=/>{self.words(2, 8)}</a></h4><p>{self.prose(1)}</p></div>" for _ in range(r.randint(2, 4)))])
            return self.box(r.choice(["<h3>Related articles</h3>", "<h3>Read more</h3>", "<h4>You may also like</h4>", f"<h3>{self.words(1, 3)}</h3>"]) + inner, TOKENS["related"], "div section aside", 0.85)
        if kind == "notice":
            text = r.choice(["We use cookies. ", "This site uses cookies. ", "By continuing you agree. ", "", "", ""]) + self.prose(r.randint(1, 3))
            return self.box(r.choice([text, f"<p>{text}</p>"]) + r.choice(["", "<button>OK</button>", f"<a href=/p>{self.words(1, 2)}</a>"]), TOKENS["notice"], "div div section aside p", 0.92)
        if kind == "form":
            inner = r.choice(["", "<h3>Subscribe</h3>", f"<p>{self.prose(1)}</p>", f"<label>{self.words(1, 3)}</label>"]) + "<input name=q><button>Go</button>" + r.choice(["", f"<p>{self.words(3, 12)}</p>"])
            return f'<form data-y="0"{self.attr(TOKENS["form"], 0.5)}>{inner}</form>' if r.random() < 0.8 else self.box(inner, TOKENS["form"], "div section", 0.95)
        if kind == "comments":
            one = lambda: r.choice(["<li>{}</li>", "<div" + self.attr(TOKENS["comment"], 0.6) + ">{}</div>", "<p>{}</p>", "<article>{}</article>"]).format(r.choice(["", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>"]) + r.choice([self.prose(r.randint(1, 4)), f"<p>{self.prose(r.randint(1, 4))}</p>"]))
            return self.box(r.choice(["<h3>Comments</h3>", "<h2>3 comments</h2>", "<h3>Leave a reply</h3>", "", f"<h3>{self.words(1, 2)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6))), TOKENS["comment"], "div div section ol ul aside", 0.95)
        if kind == "aside":
            inner = r.choice([f"<ul>{self.links(2, 9)}</ul>", f"<h3>{self.words(1, 4)}</h3><p>{self.prose(r.randint(1, 3))}</p>", f"<p>{self.prose(r.randint(1, 4))}</p>", self.prose(r.randint(1, 2))])
            return f'<aside data-y="0"{self.attr(TOKENS["side"], 0.5)}>{inner}</aside>' if r.random() < 0.6 else self.box(inner, TOKENS["side"], "div section", 0.95)
        return self.box(r.choice([f"By {self.words(1, 2)}", self.words(2, 5), self.links(1, 4, "span")]), TOKENS["meta"], "div p div", 0.95)

    def page(self) -> str:
        r = self.r
        before, after = [], []
        if r.random() < 0.6:
            inner = r.choice([f"<ul>{self.links(2, 9)}</ul>", self.links(2, 9, "span"), "".join(f"<a href=/>{self.words(1, 2)}</a> " for _ in range(r.randint(2, 8)))])
            before.append(f'<nav data-y="0"{self.attr(TOKENS["menu"], 0.4)}>{inner}</nav>' if r.random() < 0.65 else self.box(inner, TOKENS["menu"], "div ul div", 0.85))
        if r.random() < 0.4:
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<a href=/>{self.words(1, 3)}</a>", f"<div>{self.words(1, 5)}</div><p>{self.prose(1)}</p>", f"<p>{self.prose(1)}</p>", self.words(1, 6)])
            before.append(f'<header data-y="0"{self.attr(TOKENS["head"], 0.5)}>{inner}</header>' if r.random() < 0.75 else self.box(inner, TOKENS["head"], "div", 0.95))
        r.shuffle(before)
        for side, n in ((before, r.choice([0, 0, 1, 1, 2])), (after, r.choice([0, 0, 0, 1, 2, 3]))):
            side += [self.insert() for _ in range(n)]
        if r.random() < 0.75:
            inner = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(r.randint(1, 2))}", f"<p>Copyright {self.words(1, 3)}. {self.prose(1)}</p>", self.prose(r.randint(1, 2)), f"<ul>{self.links(2, 6)}</ul>", f"<p>{self.prose(r.randint(1, 3))}</p>"])
            after.append(f'<footer data-y="0"{self.attr(TOKENS["foot"], 0.4)}>{inner}</footer>' if r.random() < 0.75 else self.box(inner, TOKENS["foot"], "div", 0.95))
        body = self.body()
        x = r.random()
        if r.random() < 0.05:  # nothing but surroundings
            body = "".join(self.insert() for _ in range(r.randint(0, 3)))
        elif x < 0.5:
            body = f'<article data-y="1"{self.attr(TOKENS["main"], 0.3)}>{body}</article>'
        elif x < 0.65:
            body = f'<main data-y="1"{self.attr(TOKENS["main"], 0.2)}>{body}</main>'
        elif x < 0.9:
            body = f'<div data-y="1"{self.attr(TOKENS["main"], 0.7)}>{body}</div>'
        else:
            body = f'<section data-y="1"{self.attr(TOKENS["main"], 0.5)}>{body}</section>'
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        if r.random() < 0.2:
            body = f"<div{self.attr('wrap wrapper container layout row', 0.9)}>{body}{''.join(after[:-1])}</div>"
            after = after[-1:]
        head = "<head><title>t</title><style>p{}</style></head>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{body}{''.join(after)}" + r.choice(["</body></html>", ""])


def labelled(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes have a label, by the closest mark above, and the labels."""
    mark = page.mark[:]
    for i in range(1, len(mark)):
        mark[i] = mark[i] or mark[page.parent[i]]
    return np.array([m != "" for m in mark]), np.array([m == "1" for m in mark], np.float64)


@cache
def model(pages: int = 2000, seed: int = 11) -> Boosted:
    """Trees over the generator's pages."""
    maker = _Maker(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page = read(maker.page())
        known, y = labelled(page)
        x = features(page)
        xs.append(x[known])
        ys.append(y[known])
        ws.append(1 + np.sqrt(np.expm1(x[known][:, 5])) / 4)  # by words
    return boost(np.concatenate(xs), np.concatenate(ys), rounds=70, depth=5, rate=0.25, least=8, subsample=0.6, columns=0.5, weight=np.concatenate(ws), seed=seed)


def extract(pages: list[str | None], trees: Boosted, nodes: int = 50_000) -> list[str]:
    """Main texts of some pages; those of about `nodes` nodes together are scored at once."""
    out: list[str] = []
    held: list[Page] = []
    size = 0
    for k, source in enumerate(pages, 1):
        held.append(read(source))
        size += len(held[-1].tag)
        if size >= nodes or k == len(pages):
            odds = trees.logit(np.concatenate([features(p) for p in held]) if len(held) > 1 else features(held[0]))
            ends = np.cumsum([len(p.tag) for p in held])
            out += [main_text(p, odds[e - len(p.tag) : e]) for p, e in zip(held, ends, strict=True)]
            held, size = [], 0
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Boosted | None = None) -> DataFrame:
    """(id, url, text, n_chars) per row."""
    sent = pages.sparkSession.sparkContext.broadcast(trees or model())
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    names = [id_col, url_col, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                s = b.slice(i, 500)
                texts = extract(s.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return pages.select(id_col, url_col, F.col(html_col).cast("string")).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
