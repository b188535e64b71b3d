"""Main text of web pages by a linear-chain CRF over DOM leaf blocks (operator 2).

A page is cut into leaf blocks: runs of text between the borders of block elements.
Each block has features of its ancestors (tags, words of class, id and role) and of
its text (length, links, signs, words that notices use, place in the page). A
two-label chain (article or not) with learned weights is decoded by Viterbi.

The model is trained here, on labelled pages: a table of (html) in which the first
character of every article block's text is ``MARK``. ``labelled_pages`` writes a
bounded set of invented ones whose layouts vary (with and without speaking tags).

Defined results: null and empty html give an empty text; unclosed and misnested
tags, cut-off tags and raw elements are read as browsers do, and an unclosed head ends
where a body's content begins; formulas are text, without their annotations; a button is a control and
left out where its block holds nothing else, but words of a sentence where it stands in one, and an
unclosed button hides nothing; text outside any
element is a block like others; repeated rows are treated alike.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = ""

# Element kinds of HTML.
RAW = frozenset("script style noscript template iframe object svg head title textarea select option canvas audio video annotation annotation-xml".split())
#: Of these, the content up to the end tag is not markup.
UNPARSED = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input "
    "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
#: Elements of formulas and drawings, which a slash ends.
FOREIGN = frozenset(t for t in INLINE if t[0] == "m" and t != "mark") | {"svg", "semantics", "annotation", "annotation-xml"}
#: A head ends, closed or not, where anything else begins.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: A start tag of these ends an open element of the same group within the same container.
CLOSES = {t: frozenset(x) for x in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in x}
CONTAINERS = frozenset("ul ol dl table tbody thead div section article aside nav header footer main form body html".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>)?")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMING = frozenset(("class", "id", "role", "aria-label"))
_NAMES = re.compile(r"[a-z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int = 0
    label: int = -1
    features: list[str] = field(default_factory=list)


def _told(attributes: str) -> tuple[tuple[str, ...], bool]:
    """The words that name an element, and whether it is hidden (by attribute or style, not by what a value says)."""
    words, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in _NAMING:
            words += _NAMES.findall(value.lower())
        elif name == "hidden" or (name == "style" and _NOT_SHOWN.search(value)):
            hidden = True
    return tuple(words), hidden


_BUTTON = re.compile(r"<(/?)button(?=[\s/>])", re.I)


def _closed_buttons(page: str) -> set[int]:
    """Where buttons begin that an end tag closes before the next one begins."""
    closed, last = set(), -1
    for m in _BUTTON.finditer(page):
        if m[1] and last >= 0:
            closed.add(last)
        last = -1 if m[1] else m.start()
    return closed


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order, their text decoded and with single blanks."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    linked, links, hidden, at = 0, 0, 0, 0
    # ends of closed buttons; whether text stands in one, and whether the block has other text
    buttons = _closed_buttons(page)
    pressed, plain = 0, False

    def flush():
        nonlocal linked, plain
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text and not hidden and plain:
            found.append(Block(text, tuple((t, n) for t, n, _ in stack if t not in INLINE), min(1.0, linked / len(text))))
        parts.clear()
        linked, plain = 0, False

    def pop():
        nonlocal links, hidden
        tag, _, off = stack.pop()
        links -= tag == "a"
        hidden -= off

    def close(tags, within=frozenset()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in within:
                return

    def say(text: str):
        nonlocal linked, plain
        if stack and stack[-1][0] == "head" and text.strip():
            close({"head"})
        if hidden:
            return
        parts.append(text)
        plain = plain or (not pressed and not text.isspace())
        if links:
            linked += len(text)

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[4]:
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            if end < 0:
                break
        tag = m[2].lower()
        if m[1]:
            if tag == "button":
                pressed = 0
                continue
            if tag not in INLINE:
                flush()
            if tag in INLINE:
                close({tag}, CONTAINERS)
            else:
                close({tag})
            continue
        if tag not in IN_HEAD and any(t == "head" for t, _, _ in stack):
            flush()
            close({"head"})
        if tag == "button":
            pressed = int(lt in buttons)
            continue
        if tag not in INLINE:
            if tag == "br":
                say(" ")
                continue
            flush()
            if tag in ENDS_P:
                close({"p"}, CONTAINERS | {"td", "th", "li"})
            if tag in CLOSES:
                close(CLOSES[tag], CONTAINERS - {"tbody", "thead"} if tag == "tr" else CONTAINERS)
        if tag in VOID:
            continue
        if tag in UNPARSED:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else len(page)
            at = at or len(page)
            continue
        if m[3].endswith("/") and tag in FOREIGN:
            continue
        names, off = _told(m[3]) if m[3] else ((), False)
        off = off or tag in RAW
        stack.append((tag, names, off))
        links += tag == "a"
        hidden += off
    flush()
    return found


# Words that notices, menus and calls to action use.
SAYS = {
    "copyright": "© copyright rights reserved imprint impressum mentions aviso",
    "notice": "cookie cookies consent privacy gdpr datenschutz confidentialité privacidad accept",
    "action": "subscribe newsletter share follow login register reply advertisement sponsored sponsor anzeige publicité publicidad abonnieren",
    "comment": "comment comments commented replied posted wrote says",
}
#: Notices are short: in longer blocks these words are just words.
NOTICE_WORDS = 60
_SAYS = {w: k for k, words in SAYS.items() for w in words.split()}
_WORD = re.compile(r"©|[^\W\d_]+")


#: A block of so few words that are all links is like a menu's entry.
MENU_WORDS = 5


def features(found: list[Block]) -> None:
    n = len(found)
    entry = [b.linked > 0.9 and b.text.count(" ") < MENU_WORDS for b in found]
    for i, b in enumerate(found):
        f = ["bias"]
        tags = [t for t, _ in b.path]
        f += [f"in:{t}" for t in set(tags)]
        f.append("at:" + "/".join(tags[-2:]))
        f += {f"name:{w}" for _, names in b.path for w in names}
        words = b.text.count(" ") + 1
        f.append(f"words:{min(8, words.bit_length())}")
        f.append(f"linked:{min(4, int(b.linked * 4))}")
        if entry[i]:
            f.append("entry")
            f.append(f"entries:{(i > 0 and entry[i - 1]) + (i + 1 < n and entry[i + 1])}")
        f.append(f"ends:{b.text[-1] in '.!?…:;»”'}")
        f.append(f"marks:{min(4, sum(b.text.count(x) for x in '|•·»>'))}")
        if words <= NOTICE_WORDS:
            f += {f"says:{_SAYS[w]}" for w in _SAYS.keys() & set(_WORD.findall(b.text.lower()))}
        f.append(f"place:{min(3, i)}" if i < 3 else f"end:{min(3, n - 1 - i)}" if n - i < 4 else "middle")
        if i == 0 or b.path != found[i - 1].path:
            f.append("turn")
        b.features = f


class Model:
    """Emission weights of (feature, label) and transitions between labels; label 1 is article."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        self.emit = np.zeros((len(known), 2))
        self.move = np.zeros((2, 2))

    def scores(self, found: list[Block]) -> np.ndarray:
        known = self.known
        out = np.zeros((len(found), 2))
        for i, b in enumerate(found):
            out[i] = self.emit[[known[x] for x in b.features if x in known]].sum(0)
        return out

    def viterbi(self, emission: np.ndarray) -> list[int]:
        (m00, m01), (m10, m11) = self.move.tolist()
        back, a, b = [], 0.0, 0.0
        for i, (x, y) in enumerate(emission.tolist()):
            if i:
                from_a, from_b = (a + m00 < b + m10), (a + m01 < b + m11)
                back.append((from_a, from_b))
                a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
            else:
                a, b = x, y
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        if not found:
            return ""
        features(found)
        return " ".join(b.text for b, keep in zip(found, self.viterbi(self.scores(found)), strict=True) if keep)


def _expected(emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and of neighbouring pairs (forward-backward in log space)."""
    n = len(emission)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[0] = emission[0]
    for i in range(1, n):
        alpha[i] = emission[i] + np.logaddexp(alpha[i - 1, 0] + move[0], alpha[i - 1, 1] + move[1])
    for i in range(n - 2, -1, -1):
        beta[i] = np.logaddexp(move[:, 0] + emission[i + 1, 0] + beta[i + 1, 0], move[:, 1] + emission[i + 1, 1] + beta[i + 1, 1])
    total = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
    single = np.exp(alpha + beta - total)
    pairs = np.exp(alpha[:-1, :, None] + move + (emission + beta)[1:, None, :] - total).sum(0) if n > 1 else np.zeros((2, 2))
    return single, pairs


def fit(pages: list[str], rounds: int = 25, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximum likelihood with AdaGrad over pages whose article blocks begin with MARK."""
    data = []
    for page in pages:
        found = blocks(page)
        for b in found:
            b.label = int(MARK in b.text)
            b.text = b.text.replace(MARK, "")
        found = [b for b in found if b.text]  # a page may end right after a mark
        features(found)
        if found:
            data.append(found)
    model = Model({x: i for i, x in enumerate(sorted({x for found in data for b in found for x in b.features}))})
    rows = [[np.array([model.known[x] for x in b.features]) for b in found] for found in data]
    emit_sum, move_sum = np.full(model.emit.shape, 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(2)
    for _ in range(rounds):
        for p in rng.permutation(len(data)):
            found, row = data[p], rows[p]
            single, pairs = _expected(np.stack([model.emit[r].sum(0) for r in row]), model.move)
            truth = np.array([b.label for b in found])
            single[np.arange(len(found)), truth] -= 1
            np.add.at(pairs, (truth[:-1], truth[1:]), -1)
            at = np.concatenate(row)
            g = np.zeros_like(model.emit)
            np.add.at(g, at, np.repeat(single, [len(r) for r in row], axis=0))
            some = np.unique(at)
            g = g[some] + decay * model.emit[some]
            emit_sum[some] += g**2
            model.emit[some] -= rate * g / np.sqrt(emit_sum[some])
            move_sum += pairs**2
            model.move -= rate * pairs / np.sqrt(move_sum)
    return model


def labelled_pages(n: int = 500, seed: int = 2) -> list[str]:
    """Invented pages, the article's blocks marked. Words are random, so only form can be learned."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("aeiourntslc") for _ in range(rng.randint(2, 9)))

    def text(low, high, end="."):
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + end

    def boiler(kind):
        links = "".join(f'<li><a href="/{word()}">{word().capitalize()}</a></li>' for _ in range(rng.randint(3, 8)))
        menu = rng.choice([f"<ul>{links}</ul>", " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(4)), links.replace("<li>", "<div>").replace("</li>", "</div>")])
        prose = lambda: " ".join(text(3, 14) for _ in range(rng.randint(1, 3)))
        wrap = lambda tag, names, inner: f'<{tag}{rng.choice(["", f" class=\"{rng.choice(names)}\"", f" id=\"{rng.choice(names)}\""]) if tag not in ("div", "section", "p") else f" {rng.choice(["class", "id"])}=\"{rng.choice(names)}\""}>{inner}</{tag}>'
        if kind == "bare":
            return rng.choice([f"<div>{menu}</div>", f"<ul>{links.replace('</li>', '')}</ul>", f"<table><tr><td>{menu}</td></tr></table>", f"<p>{menu}</p>"])
        if kind == "nav":
            return wrap(rng.choice(["nav", "div", "nav"]), ["nav", "menu", "main-menu", "navbar", "breadcrumb", "navigation", "topnav", "site-nav"], menu)
        if kind == "header":
            return wrap(rng.choice(["header", "div"]), ["header", "site-header", "top", "masthead", "banner", "logo"], rng.choice([f"<p>{text(2, 8, '')}</p>", text(2, 5, ""), f"<h1>{text(1, 3, '')}</h1>{menu}"]))
        if kind == "footer":
            inner = rng.choice([f"&copy; {word()}.example.com &middot; {prose()}", f"<p>Copyright 20{rng.randint(10, 29)} {word()}. All rights reserved.</p>", f"<p>{prose()}</p>{menu}", menu])
            return wrap(rng.choice(["footer", "footer", "div"]), ["footer", "site-footer", "bottom", "copyright", "legal", "foot"], inner)
        if kind == "aside":
            inner = rng.choice([f"<h3>{text(1, 4, '')}</h3>{menu}", f"<p>{prose()}</p>", f"<h4>{text(2, 5, '')}</h4><p>{prose()}</p>"])
            return wrap(rng.choice(["aside", "div", "section"]), ["sidebar", "related", "widget", "side", "recommended", "popular", "more-stories", "see-also"], inner)
        if kind == "ad":
            inner = rng.choice([prose(), f"<p>{prose()}</p>", f'<a href="/{word()}">{prose()}</a>', f"Advertisement {prose()}"])
            return wrap(rng.choice(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement", "ad-slot"], inner)
        if kind == "notice":
            inner = rng.choice([f"<p>We use cookies. {prose()}</p>", f"<p>{prose()}</p><button>{word()}</button>", prose()])
            return wrap(rng.choice(["div", "section", "aside"]), ["cookie", "cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "notification", "popup", "modal"], inner)
        if kind == "form":
            inner = f"<label>{text(1, 4, '')}</label><input name=q><p>{prose()}</p><button>{word()}</button>"
            return f'<form{rng.choice(["", " class=newsletter", " id=search"])}>{inner}</form>' if rng.random() < 0.8 else f'<div class="{rng.choice(["newsletter", "subscribe", "signup", "search", "login"])}">{inner}</div>'
        if kind == "share":
            return wrap("div", ["share", "social", "tags", "byline-links", "toolbar", "pagination", "pager"], menu)
        items = "".join(rng.choice([f'<div class="comment"><p>{prose()}</p></div>', f"<li><b>{word()}</b> <p>{prose()}</p></li>", f"<p>{prose()}</p>"]) for _ in range(rng.randint(1, 5)))
        return wrap(rng.choice(["section", "div", "ol", "ul"]), ["comments", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments", "comment-thread"], f"{rng.choice(['', f'<h3>{rng.randint(1, 9)} comments</h3>', '<h2>Comments</h2>'])}{items}")

    def paragraph():
        said = MARK + " ".join(text(1, 25, rng.choice("....!?")) for _ in range(rng.choice([1, 1, 2, 4, 8])))
        if rng.random() < 0.15:
            said = said.replace(" ", f' <a href="/{word()}">', 1) + "</a>"
        if rng.random() < 0.1:
            said = said.replace(" ", " &amp; ", 1)
        return said

    def body():
        para = rng.choice(["p", "p", "p", "p", "div"])
        out = [f"<h{rng.choice('112')}>{MARK}{text(2, 10, rng.choice(['', '.']))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 4, 8, 12])):
            kind = rng.random()
            if kind < 0.7:
                out.append(f"<{para}>{paragraph()}</{para}>")
            elif kind < 0.78:
                out.append(f"<p><b>{paragraph()}<br><p>{paragraph()}</p>")
            elif kind < 0.84:
                out.append(f"<h{rng.choice('23')}>{MARK}{text(1, 6, '')}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{MARK}{text(2, 12, rng.choice(['', '.']))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{paragraph()}</p></blockquote>")
            elif kind < 0.97:
                out.append(f"<pre>{MARK}{text(2, 9, '')}</pre>")
            else:
                out.append(f"<table><tr><td>{MARK}{word()}</td><td>{MARK}{word()}</td></tr></table>")
            if rng.random() < 0.04:
                out.append(boiler(rng.choice(["ad", "share", "aside", "form"])))
        return "".join(out)

    pages = []
    for _ in range(n):
        before = "".join(boiler(k) for k in rng.sample(["nav", "header", "notice", "ad", "aside", "form", "bare"], rng.randint(0, 4)))
        after = "".join(boiler(k) for k in rng.sample(["footer", "comments", "aside", "ad", "share", "form", "notice", "nav", "bare"], rng.randint(0, 5)))
        tag = rng.choice(["<article>", "<main>", "<main><article>", '<div class="content">', '<div id="article-body">', '<div class="post entry">', '<section class="story">', "<div>", "", "<table><tr><td>", '<table class="layout"><tr><td><div>'])
        close = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", tag)))
        page = f'<!DOCTYPE html><html><head><title>{text(2, 8, "")}</title><style>p{{margin:0}}</style></head><body>{before}{tag}{body()}{close}{after}</body></html>'
        pages.append(page[: rng.randint(len(page) // 2, len(page))] if rng.random() < 0.1 else page)
    return pages


def extract(df: DataFrame, model: Model, html: str = "html", as_column: str = "main_text") -> DataFrame:
    """df with each page's main text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def f(pages: pa.Array) -> pa.Array:
        return pa.array([sent.value.extract(p.as_py()) for p in pages], pa.string())

    return df.withColumn(as_column, f(F.col(html)))
