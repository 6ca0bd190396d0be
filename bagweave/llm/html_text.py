"""HTML extraction: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements. Each node has features of its tag, its attribute tokens and its
ancestors', subtree density (text, links, tags, punctuation), depth, place and siblings. Gradient-boosted trees, fitted once on
generated pages of many layouts (`training_pages`), give the log-odds that a node leads to main text. Decoding
chooses the most likely labelling in which a dropped node has only dropped descendants, by one pass up and
one down the tree, so no kept text stands in a dropped part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed values of the HTML standard: block elements, elements without content, raw text, and what an opening tag closes.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title textarea iframe noembed noframes template head button select option".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "option", "select"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A tag's name; what is left of it, quotes honoured (possessive, so no character is read twice); an attribute, with or without a value.
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
READ_ATTRIBUTES = frozenset("class id role itemprop aria-label data-component data-testid".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

TAGS = "article aside blockquote body details dialog div dl figure footer form h1 h2 h3 h4 header li main nav ol p pre section table td ul".split()
MAIN_TOKENS = "article content body post entry main story text page prose markdown blog news copy".split()
OTHER_TOKENS = (
    "nav navigation navbar menu header masthead footer sidebar side aside ad ads advert advertisement advertising sponsor sponsored banner promo cookie cookies consent notice alert gdpr privacy comment comments reply replies discussion "
    "disqus share sharing social follow related recommended recommendations trending popular more newsletter subscribe signup login search breadcrumb breadcrumbs widget popup modal overlay toolbar pagination pager tags legal copyright skip form respond"
).split()
NUMBERS = "text link_share tag_rate stops depth place share siblings same_tag sibling_text sibling_links index words children block_text main_above other_above main_own other_own parent_text".split()


class Page:
    """The block elements of a page and its text runs (node, text) in order; a run ends at any block boundary."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.tokens, self.gold = ["html"], [-1], [frozenset()], [False]
        self.link, self.elements = [0], [0]
        self.runs: list[tuple[int, str]] = []
        self.read(source)

    def read(self, source: str) -> None:
        """One pass; each character is looked at a bounded number of times, however deep or broken the page is."""
        stack: list[tuple[str, int]] = []  # open block and unseen elements
        where: dict[str, list[int]] = {}  # their places in the stack, by name
        hidden, links, at, run = 0, 0, 0, []
        length, last = len(source), source.rfind(">")

        def opened(name: str, node: int) -> None:
            where.setdefault(name, []).append(len(stack))
            stack.append((name, node))

        def shut_to(place: int) -> None:
            """Closes what is open from that place of the stack on."""
            nonlocal hidden
            while len(stack) > place:
                name, _ = stack.pop()
                where[name].pop()
                hidden -= name in UNSEEN

        def latest(names: set[str]) -> int:
            return max((where[x][-1] for x in names if where.get(x)), default=-1)

        def flush() -> None:
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.runs.append((stack[-1][1], text))
                run.clear()

        def say(begin: int, end: int) -> None:
            if end > begin and not hidden:
                piece = source[begin:end]
                run.append(html.unescape(piece) if "&" in piece else piece)
                if links:
                    self.link[stack[-1][1]] += end - begin

        opened("html", 0)
        seek, quotes = 0, True
        while (begin := source.find("<", seek)) >= 0:
            if source.startswith("<!--", begin):
                say(at, begin)
                end = source.find("-->", begin + 4)
                at = seek = length if end < 0 else end + 3
                continue
            if begin > last:  # no tag ends any more
                break
            if source[begin + 1] in "!?":
                say(at, begin)
                at = seek = source.find(">", begin) + 1
                continue
            m = NAME.match(source, begin)
            if m is None:
                seek = begin + 1
                continue
            rest = REST.match(source, m.end()) if quotes else None
            if rest is None:  # a quote is never closed: from here on tags end at their first bracket
                quotes = False
            end = rest.end() if rest else source.find(">", m.end()) + 1
            if not end:
                break
            say(at, begin)
            at = seek = end
            inner, name = source[m.end() : end - 1], m[1].lower()
            if source[begin + 1] == "/":
                if name == "a":
                    links = 0
                elif (name in BLOCKS or name in UNSEEN) and name not in ("html", "body") and where.get(name):
                    flush()
                    links = 0
                    shut_to(where[name][-1])
                elif name in BLOCKS:
                    flush()
                continue
            if name in RAW and not inner.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                stop = close.start() if close else length
                if name not in UNSEEN:
                    say(at, stop)
                at = seek = source.find(">", stop) + 1 or length
                continue
            self.elements[stack[-1][1]] += 1
            if name == "a":
                links = 1
            elif name == "br" or name == "img":
                if not hidden:
                    run.append(" ")
            elif name in UNSEEN and name not in VOID:
                if name == "head" and len(stack) > 1:
                    continue
                flush()
                hidden += 1
                opened(name, stack[-1][1])
            elif name in BLOCKS:
                if stack[-1][0] == "head" or (name == "body" and where.get("head")):
                    shut_to(where["head"][-1])
                flush()
                links = 0
                if name in ("html", "hr"):
                    continue
                if name in ENDS_P and where.get("p"):
                    shut_to(where["p"][-1])
                if name in CLOSES:
                    shut, stops = CLOSES[name]
                    k = latest(shut)
                    if k > latest(stops):
                        while name == "tr" and k > 1 and stack[k - 1][0] in shut:
                            k -= 1
                        shut_to(k)
                tokens, gold = set(), "data-gold" in inner
                for a in ATTRIBUTE.finditer(inner):
                    if a[1].lower() in READ_ATTRIBUTES:
                        tokens.update(x.lower() for x in PART.findall(a[2] or a[3] or a[4] or ""))
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.tokens.append(frozenset(tokens))
                self.gold.append(gold)
                self.link.append(0)
                self.elements.append(0)
                if name not in VOID and not inner.endswith("/"):
                    opened(name, len(self.tag) - 1)
        say(at, length)
        flush()

    def numbers(self) -> np.ndarray:
        n = len(self.tag)
        own, stops, words, pieces = (np.zeros(n) for _ in range(4))
        first = np.full(n, np.inf)
        place = 0
        for v, text in self.runs:
            own[v] += len(text)
            stops[v] += sum(map(text.count, ".,;:!?"))
            words[v] += text.count(" ") + 1
            pieces[v] += 1
            first[v] = min(first[v], place)
            place += len(text)
        parent = np.array(self.parent)
        text, stop, word, piece, link, tags = own.copy(), stops.copy(), words.copy(), pieces.copy(), np.array(self.link, float), np.array(self.elements, float) + 1
        depth, main_above, other_above = np.zeros(n), np.zeros(n), np.zeros(n)
        main_own = np.array([len(t & MAIN) for t in self.tokens], float)
        other_own = np.array([len(t & OTHER) for t in self.tokens], float)
        for v in range(1, n):
            p = parent[v]
            depth[v], main_above[v], other_above[v] = depth[p] + 1, main_above[p] + main_own[p], other_above[p] + other_own[p]
        for v in range(n - 1, 0, -1):
            for x in (text, stop, word, piece, link, tags):
                x[parent[v]] += x[v]
            first[parent[v]] = min(first[parent[v]], first[v])
        first[np.isinf(first)] = place
        children = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
        child_text, child_link = (np.bincount(parent[1:], x[1:], n) if n > 1 else np.zeros(n) for x in (text, link))
        same, index, seen = np.zeros(n), np.zeros(n), {}
        for v in range(1, n):
            k = (parent[v], self.tag[v])
            seen[k] = seen.get(k, 0) + 1
            index[v] = seen[k]
        for v in range(1, n):
            same[v] = seen[parent[v], self.tag[v]]
        up = np.maximum(parent, 0)
        per = lambda a, b: np.maximum(a, 0) / np.maximum(b, 1)
        return np.stack([
            np.log1p(text), per(link, text), per(tags, text), per(stop, word), depth, per(first, place), per(text, place), children[up], per(same, children[up]),
            np.log1p(per(child_text[up] - text, children[up] - 1)), per(child_link[up] - link, child_text[up] - text), index, np.log1p(word), children, np.log1p(per(text, piece)),
            main_above, other_above, main_own, other_own, np.log1p(text[up]),
        ], 1)

    def marks(self) -> list[int]:
        """A set of bits for each node: its tag, its main and other tokens, the other tokens and the tags above it."""
        base, other = len(TAGS), len(TAGS) + len(MAIN_TOKENS)
        above = other + len(OTHER_TOKENS)
        own = []
        for tag, tokens in zip(self.tag, self.tokens, strict=True):
            bits = 1 << TAG_AT[tag] if tag in TAG_AT else 0
            for x in tokens:
                if x in TOKEN_AT:
                    bits |= 1 << base + TOKEN_AT[x]
            own.append(bits)
        out = own[:1]
        for v in range(1, len(own)):
            p = self.parent[v]
            up = (own[p] >> other) | (own[p] & ((1 << base) - 1)) << len(OTHER_TOKENS)
            out.append(own[v] | (out[p] >> above << above) | up << above)
        return out

    def features(self) -> np.ndarray:
        return dense(self.numbers(), self.marks())

    def labels(self) -> np.ndarray:
        """1 for nodes that lead to text of marked nodes."""
        keep = np.zeros(len(self.tag), bool)
        for v, _ in self.runs:
            u = v
            while u >= 0 and not self.gold[u]:
                u = self.parent[u]
            if u >= 0:
                while v >= 0:
                    keep[v], v = True, self.parent[v]
        return keep

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The most likely labelling in which dropped nodes have only dropped descendants."""
        n = len(self.tag)
        keep, drop = odds.copy(), np.zeros(n)  # log-odds of keeping against dropping
        for v in range(n - 1, 0, -1):
            keep[self.parent[v]] += max(keep[v], drop[v])
        out = np.zeros(n, bool)
        for v in range(n):
            out[v] = (v == 0 or out[self.parent[v]]) and keep[v] > drop[v]
        return out

    def text(self, kept: np.ndarray) -> str:
        return "\n\n".join(text for v, text in self.runs if kept[v])


def dense(numbers: np.ndarray, marks: list[int]) -> np.ndarray:
    width = 2 * len(TAGS) + len(MAIN_TOKENS) + 2 * len(OTHER_TOKENS)
    size = -(-width // 8)
    bits = np.frombuffer(b"".join(m.to_bytes(size, "little") for m in marks), np.uint8).reshape(len(marks), size)
    return np.concatenate([numbers, np.unpackbits(bits, axis=1, bitorder="little")[:, :width]], 1)


MAIN, OTHER = frozenset(MAIN_TOKENS), frozenset(OTHER_TOKENS)
TAG_AT = {t: i for i, t in enumerate(TAGS)}
TOKEN_AT = {t: i for i, t in enumerate([*MAIN_TOKENS, *OTHER_TOKENS])}


class BoostedTrees:
    """Logistic boosting of depth-limited trees; the first ``numbers`` features are binned, the others are 0 or 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, numbers: int, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> None:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(numbers)]
        binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
        marks = x[:, numbers:].astype(np.float32)
        mean = y.mean()
        self.start = float(np.log(mean / (1 - mean)))
        self.trees: list[list[tuple[int, float] | float | None]] = []
        score = np.full(len(y), self.start)

        def gains(gl: np.ndarray, hl: np.ndarray, gs: float, hs: float) -> np.ndarray:
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (np.maximum(hs - hl, 0) + ridge) - gs**2 / (hs + ridge)
            return np.where((hl < 1e-3) | (hs - hl < 1e-3), 0, gain)

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            tree: list = [None] * (2 ** (depth + 1) - 1)
            node = np.zeros(len(y), int)
            for k in range(len(tree)):
                own = np.flatnonzero(node == k)
                if not len(own):
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                best, feature, cut = 1e-6, None, 0.0
                if k < 2**depth - 1 and len(own) >= 10:
                    for j, e in enumerate(edges):
                        if len(e):
                            bin_of = binned[j][own]
                            gain = gains(np.cumsum(np.bincount(bin_of, g[own], len(e) + 1))[:-1], np.cumsum(np.bincount(bin_of, h[own], len(e) + 1))[:-1], gs, hs)
                            if (i := int(gain.argmax())) >= 0 and gain[i] > best:
                                best, feature, cut = gain[i], j, float(e[i])
                    part = marks[own]
                    gain = gains(gs - g[own] @ part, hs - h[own] @ part, gs, hs)
                    if gain[i := int(gain.argmax())] > best:
                        best, feature, cut = gain[i], numbers + i, 0.5
                if feature is None:
                    tree[k] = rate * gs / (hs + ridge)
                    score[own] += tree[k]
                    node[own] = -1
                else:
                    tree[k] = (feature, cut)
                    node[own] = 2 * k + 1 + (x[own, feature] > cut)
            self.trees.append(tree)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                k, own = todo.pop()
                if not len(own):
                    continue
                if isinstance(tree[k], tuple):
                    j, cut = tree[k]
                    right = x[own, j] > cut
                    todo += [(2 * k + 1, own[~right]), (2 * k + 2, own[right])]
                elif tree[k] is not None:
                    out[own] += tree[k]
        return out


def training_pages(n: int, seed: int = 3) -> Iterator[str]:
    """Generated pages whose main text carries data-gold: layouts, names and lengths vary, words mean nothing."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 10)))

    def say(low: int, high: int) -> str:
        words = [word() + (pick(",", ".", "") if chance(0.2) else "") for _ in range(rng.integers(low, high))]
        return " ".join(words).capitalize() + pick(".", ".", "", "!")

    def named(tag: str, *names: str) -> str:
        name = pick(*names) if names else ""
        name = pick(name, name, f"{name}-{word()}", f"{word()}-{name}", f"site-{name}", f"{name}s") if name else ""
        return f"<{tag}{f' {pick("class", "class", "id")}={chr(34)}{name}{chr(34)}' if name and chance(0.9) else ''}>"

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{say(1, 4)}</a></li>' for _ in range(rng.integers(2, 12)))
        return pick(f"<ul>{items}</ul>", f"<ul class='menu'>{items}</ul>", re.sub("</?li>", " ", items))

    def boiler(kind: str) -> str:
        if kind == "nav":
            tag = pick("nav", "nav", "div", "ul")
            return named(tag, "nav", "menu", "navbar", "breadcrumb", "navigation") + menu() + f"</{tag}>" if tag != "div" else '<div class="menu">' + menu() + "</div>"
        if kind == "header":
            tag = pick("header", "header", "div")
            return (f"<{tag}>" if tag == "header" and chance(0.5) else f'<{tag} class="{pick("header", "site-header", "masthead", "top-banner")}">') + pick(f"<h1>{say(1, 5)}</h1>", f"<p>{say(2, 8)}</p>", f"<div>{say(1, 5)}</div>", say(1, 6)) + (menu() if chance(0.4) else "") + f"</{tag}>"
        if kind == "footer":
            tag = pick("footer", "footer", "div")
            return (f"<{tag}>" if tag == "footer" and chance(0.6) else f'<{tag} class="{pick("footer", "site-footer", "copyright", "legal")}">') + pick(f"&copy; {say(2, 12)}", f"<p>&copy; {say(3, 25)}</p>", f"{say(3, 20)} &middot; {say(2, 9)}", menu() + f"<p>{say(2, 20)}</p>") + f"</{tag}>"
        if kind == "aside":
            tag = pick("aside", "aside", "div", "section")
            return (f"<{tag}>" if tag == "aside" and chance(0.5) else f'<{tag} {pick("class", "id")}="{pick("sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "trending", "popular-posts", "newsletter", "more")}">') + (f"<h{pick(2, 3, 4)}>{say(1, 4)}</h3>" if chance(0.6) else "") + pick(menu(), f"<p>{say(4, 40)}</p>", f"<p>{say(4, 30)}</p><p>{say(4, 30)}</p>", say(4, 30)) + f"</{tag}>"
        if kind == "ad":
            tag = pick("div", "div", "aside", "section", "p")
            return f'<{tag} {pick("class", "class", "id")}="{pick("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner", "ad-banner", "sponsor")}">' + pick(say(3, 40), f"<p>{say(5, 50)}</p>" if tag != "p" else say(5, 50), f'<a href="/{word()}">{say(2, 15)}</a>') + f"</{tag}>"
        if kind == "notice":
            tag = pick("div", "div", "section", "dialog", "p")
            return f'<{tag} {pick("class", "id", "role")}="{pick("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "privacy-notice", "cookie-banner", "popup", "modal")}">' + (say(5, 40) if tag == "p" else pick(say(5, 40), f"<p>{say(5, 40)}</p>")) + ("<button>OK</button>" if chance(0.4) else "") + f"</{tag}>"
        if kind == "form":
            return f"<form{pick('', ' class=\"search\"', ' id=\"login\"', ' class=\"newsletter\"')}>" + pick("", f"<p>{say(2, 20)}</p>") + f"<label>{say(1, 5)}</label><input type=text>" + pick("", "<button>Go</button>") + pick("", say(2, 10)) + "</form>"
        if kind == "comments":
            tag = pick("section", "div", "div", "ol", "ul")
            inner = "li" if tag in ("ol", "ul") else pick("div", "article", "p", "li")
            body = "".join(f'<{inner}{pick("", " class=comment", " class=reply")}>' + (say(3, 60) if inner == "p" else pick(f"<p>{say(3, 60)}</p>", f"<b>{word()}</b> {say(3, 60)}", f"<h4>{word()}</h4><p>{say(3, 60)}</p><p>{say(3, 30)}</p>")) + f"</{inner}>" for _ in range(rng.integers(1, 7)))
            return f'<{tag} {pick("class", "id", "id")}="{pick("comments", "comment-list", "discussion", "replies", "disqus", "reader-comments", "respond")}">' + (f"<h{pick(2, 3)}>{say(1, 3)}</h3>" if chance(0.6) and inner != "li" else "") + body + f"</{tag}>"
        tag = pick("div", "ul", "p")
        return f'<{tag} class="{pick("share", "social", "tags", "pagination", "breadcrumbs", "toolbar", "byline-share")}">' + (menu().replace("<ul", "<div").replace("</ul", "</div") if tag == "div" else f'<a href="/{word()}">{say(1, 3)}</a> ' * 3) + f"</{tag}>"

    def paragraph() -> str:
        size = pick((1, 4), (2, 9), (8, 40), (20, 120), (40, 220))
        linked = re.sub(r"^(\w+)", r'<a href="/x">\1</a>', say(*size)) if chance(0.12) else say(*size)
        return pick(f"<p>{linked}</p>", f"<p>{linked}</p>", f"<p>{linked}", f"<p><b>{say(2, 12)}<br><p>{linked}</p>", f"<p><em>{linked}</em></p>")

    def main() -> str:
        out = [f"<h1>{say(1, 12)}</h1>"] if chance(0.7) else []
        for _ in range(int(pick(1, 2, 4, 8, 15, 25))):
            out.append(pick(paragraph, paragraph, paragraph, paragraph, paragraph, paragraph, lambda: f"<h{pick(2, 3)}>{say(1, 8)}</h2>", lambda: "<ul>" + "".join(f"<li>{say(1, 20)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>", lambda: f"<blockquote><p>{say(5, 50)}</p></blockquote>", lambda: f"<pre>{say(3, 20)}</pre>", lambda: f"<table><tr><td>{say(1, 4)}<td>{say(1, 4)}<tr><td>{say(1, 4)}<td>{say(1, 4)}</table>", lambda: f"<div>{say(8, 60)}</div>", lambda: f"<figure><figcaption>{say(2, 12)}</figcaption></figure>")())
        return "".join(out)

    for _ in range(n):
        text = re.sub(r"<(p|h1|h2|h3|li|div|td|pre|figcaption|blockquote)>", r"<\1 data-gold>", main())
        if chance(0.35):  # boilerplate between the paragraphs
            k = text.find("<p", int(rng.integers(0, len(text))))
            text = text[:k] + boiler(pick("ad", "aside", "share", "notice", "form")) + text[k:] if k > 0 else text
        tail = boiler("comments") if chance(0.3) else ""
        tag = pick("article", "article", "main", "div", "div", "section")
        inside = text + (tail if chance(0.4) else "")
        box = (f"<{tag}>" if tag in ("article", "main") and chance(0.6) else f'<{tag} {pick("class", "id")}="{pick("content", "article", "post", "entry-content", "main", "story-body", "article-body", "post-content", "page-content", "text")}">') + inside + f"</{tag}>"
        if inside == text:
            box += tail
        if chance(0.3):
            box = pick('<div class="container">', "<main>", '<div id="wrapper">', "<div>", '<section class="page">') + box + pick("</div>", "</main>", "</section>")
        if chance(0.3):
            box = f"<div>{box}{boiler('aside')}</div>"
        before = [boiler(k) for k in ("header", "nav", "ad", "notice", "form", "aside") if chance(0.45)]
        after = [boiler(k) for k in ("aside", "ad", "share", "form", "notice", "nav", "footer", "footer") if chance(0.4)]
        yield f"<html><head><title>{say(2, 8)}</title></head><body>{''.join(before)}{box}{''.join(after)}" + pick("</body></html>", "")


#: The model is fitted on so many generated pages.
TRAINING_PAGES = 600
#: Pages that are parsed together: so many, or fewer of that many characters; and nodes whose features are spread out at once (1.8 KB each).
PAGES_AT_ONCE, CHARS_AT_ONCE, NODES_AT_ONCE = 128, 1 << 21, 1 << 14
_fitted: dict[tuple[int, int], BoostedTrees] = {}


def fitted(n: int = TRAINING_PAGES, seed: int = 3) -> BoostedTrees:
    if (n, seed) not in _fitted:
        x, y = [], []
        for source in training_pages(n, seed):
            page = Page(source)
            x.append(page.features()[1:])
            y.append(page.labels()[1:])
        _fitted[n, seed] = BoostedTrees(np.concatenate(x), np.concatenate(y).astype(float), len(NUMBERS))
    return _fitted[n, seed]


def main_texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page; nodes of several pages, or of a part of a large one, are scored at once."""
    pages = [Page(source or "") for source in sources]
    if not pages:
        return []
    numbers, marks = np.concatenate([p.numbers() for p in pages]), [m for p in pages for m in p.marks()]
    odds = np.concatenate([model(dense(numbers[i : i + NODES_AT_ONCE], marks[i : i + NODES_AT_ONCE])) for i in range(0, len(marks), NODES_AT_ONCE)])
    out, at = [], 0
    for page in pages:
        own = odds[at : at + len(page.tag)]
        own[0] = 1e9  # the root is kept
        at += len(page.tag)
        out.append(page.text(page.decode(own)))
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Defined cases: null, empty and broken html is read as far as it goes and gives an empty text where nothing is left; text outside any
    element counts as the root's and is kept; repeated rows are each read; an empty table gives an empty result; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fitted())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes, i = pc.fill_null(pc.utf8_length(whole.column(2)), 0).to_numpy(zero_copy_only=False), 0
            while i < whole.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[i : i + PAGES_AT_ONCE]), CHARS_AT_ONCE, side="right")))
                b, i = whole.slice(i, n), i + n
                texts = main_texts(b.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
