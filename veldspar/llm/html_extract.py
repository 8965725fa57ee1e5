"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of elements and text blocks. A node is content, around the content's
container, or neither. A node potential weighs what the node holds: of an element the size,
share of the page and share of links of its text and its class and id words, of a block its
length, links and closing mark; a parent-child potential says how often a child of such a tag
and state stands under a parent of such a state. Sum-product message passing, leaves to root
and back, gives each block's marginal exactly. The potentials are counted on labelled pages
(here pages built with known labels, with neutral, missing and misleading names).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: Elements without content of their own, and those that end a text block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open one of these, if no element of the second kind is in between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_INLINE_P = BLOCK - {"button", "label", "option", "body", "html", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}


#: Class and id words of the parts of common page layouts.
GOOD = "article content post entry story main body text page blog news prose markdown wiki document read hentry single".split()
BAD = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav sitemap pagination pager tabs toc skip links".split(),
    "header": "header masthead topbar banner logo brand site head".split(),
    "footer": "footer foot copyright legal colophon bottom credits".split(),
    "aside": "sidebar side aside widget related recommended trending popular rail teaser more recirculation".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay banner privacy message paywall newsletter subscribe signup".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion promoted adsense commercial outbrain taboola".split(),
    "form": "form search login signin register contact field input".split(),
    "comments": "comments comment discussion replies reply respond disqus thread reader feedback reviews".split(),
    "share": "share social sharing follow buttons toolbar tools actions".split(),
}
#: Names of boxes of any kind.
PLAIN = "wrapper wrap container inner outer box block section row col list item area site layout group left right center top primary secondary main column panel".split()
#: All words that say anything; any other word of a class or id is just unknown.
WORDS = frozenset([*GOOD, *PLAIN, *(w for ws in BAD.values() for w in ws)])


class Page:
    """A page as parallel lists, parents before children; a text block has the tag ''."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.text, self.linked = [-1], ["#"], [()], [""], [0]
        self._stack = [0]
        self._open: Counter = Counter()
        self._block: list[str] = []
        self._linked = 0
        self._links = 0
        self._parse(source)

    def _flush(self) -> None:
        text = " ".join("".join(self._block).split())
        if text:
            at = next(x for x in reversed(self._stack) if self.tag[x] in BLOCK or x == 0)
            self._add(at, "", (), text, min(self._linked, len(text)))
        self._block, self._linked = [], 0

    def _add(self, parent: int, tag: str, words: tuple[str, ...], text: str = "", linked: int = 0) -> int:
        for column, v in ((self.parent, parent), (self.tag, tag), (self.words, words), (self.text, text), (self.linked, linked)):
            column.append(v)
        return len(self.tag) - 1

    def _close(self, at: int) -> None:
        """Close the stack's element number `at` and all above it."""
        for x in self._stack[at:]:
            self._links -= self.tag[x] == "a"
            self._open[self.tag[x]] -= 1
        del self._stack[at:]

    def _parse(self, source: str) -> None:
        for m in _TOKEN.finditer(source):
            whole = m[0]
            if whole[0] != "<" or whole == "<":
                text = html.unescape(whole)
                self._block.append(text)
                if self._links:
                    self._linked += len(text.strip())
                continue
            name = (m[3] or m[6] or "").lower()
            if not name:
                if m[1] or whole[:4].lower() == "<svg":
                    self._block.append(" ")
                continue
            if name == "br":
                self._block.append(" ")
                continue
            if name in BLOCK:
                self._flush()
            if m[2] or m[5]:
                # Of what is not open nothing ends, and an inline element's end ends no block.
                for k in range(len(self._stack) - 1, 0, -1) if self._open[name] > 0 else ():
                    if self.tag[self._stack[k]] == name:
                        self._close(k)
                        break
                    if name not in BLOCK and self.tag[self._stack[k]] in BLOCK:
                        break
                continue
            if name in VOID:
                continue
            shut, fence = CLOSES.get(name, ({"p"}, {"table", "button"}) if name in _INLINE_P else ((), ()))
            for k in range(len(self._stack) - 1, 0, -1) if any(self._open[x] > 0 for x in shut) else ():
                tag = self.tag[self._stack[k]]
                if tag in shut:
                    self._close(k)
                    break
                if tag in fence or (tag in BLOCK and "p" in shut):
                    break
            attrs = m[4] or m[7] or ""
            words: tuple[str, ...] = ()
            if "=" in attrs:
                words = tuple(sorted({w if w in WORDS else "?" for a in _ATTR.findall(attrs) for w in _WORD.findall("".join(a).lower())}))
            self._stack.append(self._add(self._stack[-1], name, words))
            self._open[name] += 1
            self._links += name == "a"
        self._flush()
        # Text and linked text of each element, all below it included.
        self.mass, self.held = [len(t) for t in self.text], list(self.linked)
        for k in range(len(self.tag) - 1, 0, -1):
            self.mass[self.parent[k]] += self.mass[k]
            self.held[self.parent[k]] += self.held[k]

    def features(self, k: int) -> list[str]:
        n = self.mass[k]
        if not self.tag[k]:
            share = self.linked[k] / n
            return [f"chars:{min(7, n.bit_length() // 2)}", f"linked:{0 if share < 0.2 else 1 if share < 0.8 else 2}", f"stop:{self.text[k][-1] in STOPS}"]
        if not k:
            return [f"blocks:{min(4, sum(not t for t in self.tag).bit_length())}", f"chrome:{any(t in CHROME for t in self.tag)}"]
        # Words beside unknown ones tell less: a piece of content may be named after its subject.
        kind = "mixed" if "?" in self.words[k] else "word"
        out = [f"{kind}:{w}" for w in self.words[k]]
        if n:
            share = self.held[k] / n
            out += [f"mass:{min(7, n.bit_length() // 2)}", f"held:{0 if share < 0.2 else 1 if share < 0.6 else 2}", f"share:{4 * n // self.mass[0]}"]
        return out


STOPS = frozenset(".!?…:;。")
#: Elements that pages around an article have.
CHROME = frozenset("nav header footer aside form article main".split())


#: States: neither content nor around it; content; around the content's container.
OTHER, CONTENT, OUTER = 0, 1, 2
STATES = (OTHER, CONTENT, OUTER)


class TreeModel:
    """Potentials of three states.

    edge: (parent's state, child's state, child's tag) to the log of how often such a child
    stands under such a parent; node: feature to its log weight in each state; root: the log
    weights of the page's own state.
    """

    def __init__(self, node: dict[str, tuple[float, ...]], edge: dict[tuple[int, int, str], float], root: tuple[float, ...]):
        self.node, self.root = node, root
        tags = {t for _, _, t in edge}
        self.edges = {t: [[math.exp(edge.get((p, c, t), -30.0)) for c in STATES] for p in STATES] for t in tags}
        #: An unknown tag says nothing but how often states follow each other.
        self.any_tag = [[sum(self.edges[t][p][c] for t in tags) for c in STATES] for p in STATES]

    @classmethod
    def fit(cls, pages: list[tuple[Page, list[int]]]) -> TreeModel:
        """Smoothed counts. A block's own features weigh less: neighbours are not independent."""
        seen = [Counter(), Counter(), Counter()]
        total, under, root = [0, 0, 0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]
        follow: Counter = Counter()
        for page, states in pages:
            root[states[0]] += 1
            for k, s in enumerate(states):
                total[s] += 1
                seen[s].update(page.features(k))
                if k:
                    above = states[page.parent[k]]
                    follow[above, s, page.tag[k]] += 1
                    under[above] += 1
        node = {}
        for f in set().union(*seen):
            scale = 0.3 if f.startswith(("chars:", "linked:", "stop:", "mass:", "held:", "share:")) else 1.0
            node[f] = tuple(scale * math.log((seen[s][f] + 0.5) / (total[s] + 1.0)) for s in STATES)
        tags = {t for _, _, t in follow}
        edge = {}
        for t in tags:
            for p in STATES:
                for c in STATES:
                    possible = c != OUTER or p == OUTER and t != ""
                    edge[p, c, t] = math.log((follow[p, c, t] + 0.2) / (under[p] + 0.2 * 3 * len(tags))) if possible else -30.0
        return cls(node, edge, tuple(math.log(x / sum(root)) for x in root))

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node by one upward and one downward pass."""
        n = len(page.tag)
        exp, log = math.exp, math.log
        own = []
        for k in range(n):
            w = [0.0, 0.0, 0.0]
            for f in page.features(k):
                if v := self.node.get(f):
                    w = [w[0] + v[0], w[1] + v[1], w[2] + v[2]]
            own.append(w)
        edges = [self.edges.get(t, self.any_tag) for t in page.tag]
        up: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):
            a, b, c = own[k]
            top = max(a, b, c)
            a, b, c = exp(a - top), exp(b - top), exp(c - top)
            x, y, z = edges[k]
            u = (log(x[0] * a + x[1] * b + x[2] * c + 1e-300), log(y[0] * a + y[1] * b + y[2] * c + 1e-300), log(z[0] * a + z[1] * b + z[2] * c + 1e-300))
            up[k] = u
            p = own[page.parent[k]]
            p[0] += u[0]
            p[1] += u[1]
            p[2] += u[2]
        belief: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * n
        belief[0] = tuple(o + r for o, r in zip(own[0], self.root, strict=True))
        out = [0.0] * n
        for k in range(n):
            if k:
                p, u = belief[page.parent[k]], up[k]
                a, b, c = p[0] - u[0], p[1] - u[1], p[2] - u[2]
                top = max(a, b, c)
                a, b, c = exp(a - top), exp(b - top), exp(c - top)
                x, y, z = edges[k]
                o = own[k]
                belief[k] = (
                    o[0] + log(a * x[0] + b * y[0] + c * z[0] + 1e-300),
                    o[1] + log(a * x[1] + b * y[1] + c * z[1] + 1e-300),
                    o[2] + log(a * x[2] + b * y[2] + c * z[2] + 1e-300),
                )
            q = belief[k]
            top = max(q)
            q = (q[0] - top, q[1] - top, q[2] - top)
            belief[k] = q
            e = exp(q[1])
            out[k] = e / (exp(q[0]) + e + exp(q[2]))
        return out


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of a drawn layout, and the texts of its content blocks. Every block is unique."""
    count = 0
    good: set[str] = set()
    bad_words = [w for ws in BAD.values() for w in ws]

    def prose(low: int, high: int, content: bool) -> str:
        nonlocal count
        count += 1
        words = ["".join(rng.choice("aeioubcdrstnlm") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high))]
        text = " ".join([*words, f"u{count}"]) + (rng.choice([".", ".", ".", "!", ""]) if high > 9 else rng.choice(["", "", "."]))
        if content:
            good.add(text)
        return text

    def unknown() -> str:
        return "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))

    def name(words: list[str], often: float = 0.7) -> str:
        """The class or id of a part: its words, now and then with a plain or an unknown one."""
        if rng.random() > often:
            return ""
        own = rng.sample(words, rng.randint(1, 2))
        if rng.random() < 0.3:
            own.insert(rng.randint(0, len(own)), rng.choice(PLAIN))
        if rng.random() < 0.06:
            own.insert(0, unknown())
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice("- _").join(own)}"'

    def slug(often: float = 0.5) -> str:
        """The name of a piece of content: words of its subject, which may be any."""
        if rng.random() > often:
            return ""
        own = [unknown() if rng.random() < 0.6 else rng.choice([*bad_words, *PLAIN]) for _ in range(rng.randint(1, 3))]
        if all(w in bad_words for w in own):
            own.append(unknown())
        rng.shuffle(own)
        return f' {rng.choice(["class", "id", "id"])}="{"-".join(own)}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{prose(1, 3, False)}</a></li>' for _ in range(n))

    def other(kind: str) -> str:
        words = BAD[kind]
        if kind == "nav":
            listed = rng.choice(["ul", "ul", "ol"])
            inner = f"<{listed}>{links(rng.randint(2, 8))}</{listed}>" if rng.random() < 0.8 else " ".join(f'<a href="/x">{prose(1, 3, False)}</a>' for _ in range(rng.randint(2, 8)))
            return f"<nav{name(words)}>{inner}</nav>" if rng.random() < 0.6 else f"<div{name(words, 0.8)}>{inner}</div>"
        if kind == "header":
            inner = f"<h1>{prose(1, 4, False)}</h1>" if rng.random() < 0.3 else f"<p>{prose(1, 9, False)}</p>" if rng.random() < 0.5 else prose(1, 4, False)
            return f"<header{name(words)}>{inner}</header>" if rng.random() < 0.7 else f"<div{name(words, 1)}>{inner}</div>"
        if kind == "footer":
            inner = rng.choice([prose(2, 14, False), f"<p>{prose(2, 20, False)}</p>", f"<ul>{links(3)}</ul>"])
            return f"<footer{name(words)}>{inner}</footer>" if rng.random() < 0.7 else f"<div{name(words, 1)}>{inner}</div>"
        if kind == "aside":
            tag = rng.choice(["aside", "aside", "div", "section"])
            if rng.random() < 0.4:
                inner = f"<h3>{prose(1, 4, False)}</h3><ul>{links(rng.randint(2, 6))}</ul>"
            else:
                inner = "".join(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{prose(1, 4, False)}</{h}><p>{prose(2, 30, False)}</p>" for _ in range(rng.randint(1, 3)))
            return f"<{tag}{name(words, 0.6 if tag == 'aside' else 1)}>{inner}</{tag}>"
        if kind == "form":
            return f"<form{name(words)}><label>{prose(1, 3, False)}</label><input type=text><p>{prose(1, 9, False)}</p><button>{prose(1, 2, False)}</button></form>"
        if kind == "comments":
            tag = rng.choice(["section", "div", "div", "ol", "ul"])
            sub = "li" if tag in ("ol", "ul") else rng.choice(["div", "article", "p"])
            inner = "".join(f"<{sub}{name(words)}>{prose(3, 40, False) if sub == 'p' else '<p>' + prose(3, 40, False) + '</p>'}</{sub}>" for _ in range(rng.randint(1, 6)))
            h = rng.choice(["h2", "h3", "h4"])
            return f"<{tag}{name(words, 1)}>{'' if tag in ('ol', 'ul') else f'<{h}>{prose(1, 3, False)}</{h}>'}{inner}</{tag}>"
        tag = rng.choice(["div", "div", "section", "p"])
        inner = prose(1, 14, False) if tag == "p" or rng.random() < 0.5 else f"<p>{prose(2, 30, False)}</p>"
        return f"<{tag}{name(words, 1)}>{inner}</{tag}>"

    def block(depth: int = 0) -> str:
        r = rng.random()
        if r < 0.6:
            return f"<p{slug(0.06)}>{prose(1, 60, True)}</p>"
        if r < 0.68:
            return f"<{(h := rng.choice(['h2', 'h3', 'h4']))}{slug(0.3)}>{prose(1, 7, True)}</{h}>"
        if r < 0.76:
            tag = rng.choice(["ul", "ol", "ol"])
            return f"<{tag}{slug(0.1)}>" + "".join(f"<li>{prose(1, 25, True)}</li>" for _ in range(rng.randint(1, 6))) + f"</{tag}>"
        if r < 0.8:
            return "<dl>" + "".join(f"<dt>{prose(1, 3, True)}</dt><dd>{prose(2, 20, True)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
        if r < 0.83:
            return f"<blockquote><p>{prose(3, 40, True)}</p></blockquote>"
        if r < 0.86:
            return f"<pre>{prose(3, 30, True)}</pre>"
        if r < 0.89:
            return "<table>" + "".join(f"<tr><td>{prose(1, 4, True)}</td><td>{prose(1, 4, True)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if r < 0.91:
            return f"<figure><figcaption>{prose(1, 12, True)}</figcaption></figure>"
        if r < 0.92:
            return f"<details><summary>{prose(1, 6, True)}</summary><p>{prose(3, 40, True)}</p></details>"
        if depth > 2:
            return prose(4, 40, True)
        tag = rng.choice(["section", "section", "div"])
        return f"<{tag}{slug(0.8)}>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    inside = [block() for _ in range(rng.randint(1, 12))]
    # Stray pieces of text next to each other are one block: keep them apart.
    inside = [x if x.startswith("<") else f"<div>{x}</div>" for x in inside]
    if rng.random() < 0.12:  # a body, or a page, that holds nothing but its text
        bare = "".join(inside) if rng.random() < 0.7 else rng.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(prose(3, 60, True))
        good &= {t for t in good if t in bare}
        return rng.choice([f"<!DOCTYPE html><html><head><title>t</title></head><body>{bare}</body></html>", f"<html><body>{bare}</body></html>", bare]), good
    before = [other(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "share"], rng.randint(0, 5))]
    after = [other(k) for k in rng.sample(["footer", "aside", "ad", "comments", "nav", "form", "notice", "share"], rng.randint(0 if before else 1, 7))]
    for _ in range(rng.choice([0, 0, 1, 2])):
        inside.insert(rng.randint(0, len(inside)), other(rng.choice(["ad", "share", "aside", "comments", "form", "notice", "nav"])))
    title = f"<h1>{prose(1, 9, True)}</h1>" if rng.random() < 0.85 else ""
    if title and rng.random() < 0.15:
        title = f"<header>{title}</header>"
    wrap = rng.choice(["article", "article", "main", "div", "section", "body"])
    article = f"{title}{''.join(inside)}"
    if wrap != "body":
        article = f"<{wrap}{name(GOOD, 0.5 if wrap in ('article', 'main') else 0.8)}>{article}</{wrap}>"
        if rng.random() < 0.4:
            article = f"<main{name(GOOD)}>{article}</main>"
    body = "".join([*before, article, *after])
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(PLAIN)}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>", good


def labelled(source: str, good: set[str]) -> tuple[Page, list[int]]:
    """A page's states. The container is the lowest element over all content blocks, or the
    highest above it that holds nothing else: what is above it is outer, what is in it is
    content if at least half of its blocks are."""
    page = Page(source)
    n = len(page.tag)
    have, content = [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if not page.tag[k]:
            have[k], content[k] = 1, int(page.text[k] in good)
        if k:
            have[page.parent[k]] += have[k]
            content[page.parent[k]] += content[k]
    container = max((k for k in range(n) if content[k] == content[0]), default=0)
    while container and have[page.parent[container]] == content[0]:
        container = page.parent[container]
    states = [CONTENT if content[k] and 2 * content[k] >= have[k] else OTHER for k in range(n)]
    states[container] = CONTENT if content[0] else OTHER
    k = page.parent[container]
    while k >= 0:
        states[k], k = OUTER, page.parent[k]
    return page, states


def train(pages: int = 900, seed: int = 9) -> TreeModel:
    """The model from a fixed number of labelled pages."""
    rng = random.Random(seed)
    return TreeModel.fit([labelled(*training_page(rng)) for _ in range(pages)])


def extract(source: str, model: TreeModel) -> str:
    """Main text of a page: its blocks of marginal over a half, one to a line."""
    page = Page(source)
    if len(page.tag) == 1:
        return ""
    p = model.marginals(page)
    return "\n".join(t for k, t in enumerate(page.text) if t and p[k] > 0.5)


def html_extract(pages: DataFrame, key: str = "page_id", source: str = "html", keep: tuple[str, ...] = ("url",), model: TreeModel | None = None) -> DataFrame:
    """One row per input row: id, the columns of `keep`, text, n_chars (code points).

    A null or empty page has the empty text. Pages are read whole, whatever is broken in
    them and however long they are; repeated rows give repeated rows; a null id stays null;
    an empty table gives an empty result; columns other than those named are ignored. A kept
    column that is named like one of the results gets `_in` behind its name.
    """
    model = model or train()
    names = [f"{c}_in" if c in ("id", "text", "n_chars") else c for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([extract(x.as_py() or "", model) for x in b.column(b.num_columns - 1)], pa.string())], [*b.schema.names[:-1], "text"])

    own = pages.select(F.col(f"`{key}`").cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{source}`").cast("string").alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    out = own.mapInArrow(run, f"{kinds}, text string")
    return out.select("id", *[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
