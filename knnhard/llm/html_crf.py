"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with the tags and the
class, id and role words of its ancestors. Features of ancestors and text give each block a score for being
main text, a 2 x 2 matrix scores neighbours; both are trained on labelled pages by maximum
likelihood (forward-backward), and Viterbi picks the best labelling of a page.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import col, few, materialise, table

#: Elements that begin a new block (fixed by HTML).
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol
optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style template noscript iframe svg math canvas object textarea title".split())
#: Of those, the ones whose content is raw text: without a closing tag it runs to the end of the page. The others nest,
#: and one that is never closed skips nothing.
RAW = frozenset("script style textarea title".split())
#: Elements that a slash at the end of their tag closes.
_SLASHED = frozenset({"svg", "math"})
#: Block elements that an opening tag of the same kind closes.
_CLOSED_BY = {"p": BLOCK_TAGS - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
              "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
_VOID = frozenset({"hr"})
#: Elements without content that begin no block (fixed by HTML).
_INLINE_VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
#: How comments, CDATA sections, other declarations and tags begin; where the first two end is searched for once.
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
_ENDS = {"<!--": "-->", "<![CDATA[": "]]>"}
#: One attribute as HTML reads it: a quote opens a value only after "=" and the value ends at the next such quote,
#: however far; without one the quote is a character of an unquoted value.
_ATTR = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))?+)?+""")
_TAG_END = re.compile(r"[\s/]*+>")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of notices, menus and adverts.
_CUES = frozenset("""© accept advert advertisement advertisements comment comments cookie cookies copyright login menu newsletter
privacy related replies reply search share sponsored subscribe terms""".split())


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    above: frozenset[str]
    linked: int


def _names(attrs: list[tuple[str, str]]) -> set[str]:
    out: set[str] = set()
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for w in _SPLIT.findall(value):
                out.add("c:" + w.lower())
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower().startswith("true")) or (name == "style" and _HIDDEN.search(value)):
            out.add("hidden")
    return out


def _read_tag(page: str, at: int, end: int, endless: set[int]) -> tuple[int, list[tuple[str, str]]]:
    """(end, attributes) of the tag whose name ends at ``at``, read attribute by attribute.

    A tag that does not end outside its quoted values ends at the next ">". ``endless`` holds the places of the
    page from which no end is reached, so that a page is read in linear time.
    """
    attrs: list[tuple[str, str]] = []
    seen = []
    k = at
    while k not in endless:
        done = _TAG_END.match(page, k, end)
        if done:
            return done.end(), attrs
        m = _ATTR.match(page, k, end)
        if m is None:
            break
        seen.append(k)
        attrs.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        k = m.end()
    endless.update(seen)
    stop = page.find(">", at, end) + 1 or end
    k, attrs = at, []
    while m := _ATTR.match(page, k, stop - 1):
        attrs.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        k = m.end()
    return stop, attrs


def _closings(page: str, name: str) -> dict[int, int]:
    """For the place after the name of every opening tag of a nesting element that is closed: the end of its closing tag."""
    found: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*+>", page, re.I):
        if not m[1]:
            if not (name in _SLASHED and m[0].endswith("/>")):
                open_.append(m.start() + 1 + len(name))
        elif open_:
            found[open_.pop()] = m.end()
    return found


def blocks(page: str | None, known: Set[str] | None = None, max_marks: int | None = None) -> list[Block]:
    """Leaf blocks in page order; a block without text is none.

    ``above`` holds all marks of a block's ancestors, or those of them in ``known``; equal sets are one object. Marks of an
    inline element are a block's where it holds all the block's text. Custom elements begin blocks. A page
    whose sets and blocks have over ``max_marks`` marks has no blocks (for training pages, whose marks are not known yet).
    """
    page = page or ""
    end = page.rfind(">") + 1
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    inline: list[tuple[str, int, frozenset[str]]] = []  # name, height of the stack, marks with those of the ones around
    parts: list[str] = []
    cover: frozenset[str] | None = None  # marks of inline elements that hold all text of the block so far
    linked, in_link = 0, 0
    endless: set[int] = set()
    closings: dict[str, dict[int, int]] = {}
    missing: set[str] = set()
    shared: dict[frozenset[str], frozenset[str]] = {}
    marks = 0

    def share(above: frozenset[str]) -> frozenset[str]:
        nonlocal marks
        if above not in shared:
            marks += len(above)
        return shared.setdefault(above, above)

    def text_piece(piece: str) -> None:
        nonlocal cover, linked
        parts.append(piece)
        if in_link:
            linked += len(piece)
        if (cover is None or cover) and not piece.isspace():
            now = inline[-1][2] if inline else frozenset()
            cover = now if cover is None else cover & now

    def close() -> None:
        nonlocal linked, marks, cover
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                tag, above = stack[-1]
                if cover and not cover <= above:
                    above = share(above | cover)
                out.append(Block(text, tag, above, linked))
                marks += len(above)
            parts.clear()
        linked, cover = 0, None

    def lower() -> None:
        """Inline elements end with the block they began in."""
        while inline and inline[-1][1] > len(stack):
            inline.pop()

    at = 0
    while True:
        m = _TOKEN.search(page, at, end)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            text_piece(piece)
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            closing = _ENDS.get(m[0])
            stop = page.find(closing, at) if closing and closing not in missing else -1
            if stop >= 0:
                if closing == "]]>":
                    text_piece(html_lib.escape(page[at:stop]))
                at = stop + 3
                end = max(end, at)
            else:
                if closing:
                    missing.add(closing)
                at = page.find(">", at, end) + 1 or end
            continue
        name = name.lower()
        after_name = at
        at, attrs = _read_tag(page, at, end, endless)
        block = name in BLOCK_TAGS or "-" in name
        if m[1]:
            if name == "a":
                in_link = 0
            if block:
                close()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        lower()
                        break
            else:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == name:
                        del inline[i:]
                        break
        elif name in SKIPPED:
            if name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            elif not (name in _SLASHED and page[at - 2] == "/"):
                if name not in closings:
                    closings[name] = _closings(page, name)
                at = max(at, closings[name].get(after_name, at))
            end = max(end, at)
        elif name == "br":
            parts.append("\n")
        elif block:
            close()
            while len(stack) > 1 and name in _CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
                lower()
            if name not in _VOID:
                above = stack[-1][1]
                new = {"a:" + name} | (_names(attrs) if attrs else set())
                if known is not None:
                    new &= known
                if not new <= above:
                    above = share(above | new)
                stack.append((name, above))
            if max_marks is not None and marks > max_marks:
                return []
        elif name not in _INLINE_VOID:
            if name == "a":
                in_link = 1
            new = _names(attrs) if attrs else set()
            if known is not None:
                new &= known
            if new:
                around = inline[-1][2] if inline else frozenset()
                inline.append((name, len(stack), around if new <= around else share(around | new)))
    close()
    return out


def _size(n: int) -> int:
    return min(10, n.bit_length())


def text_features(b: Block) -> list[str]:
    t = b.text
    words = t.count(" ") + 1
    share = min(4, 4 * b.linked // max(1, len(t)))
    stops = t.count(".") + t.count("!") + t.count("?")
    out = [f"len{_size(len(t))}", f"words{_size(words)}", f"link{share}", f"stops{min(3, stops)}", f"commas{min(3, t.count(','))}",
           "closed" if t[-1] in ".!?…”\"'»)" else "open", f"link{share}len{_size(len(t))}"]
    out += ["w:" + c for c in _CUES.intersection(t.lower().split())]
    return out


def structure_features(b: Block) -> list[str]:
    return ["t:" + b.tag, *b.above]


@dataclass(frozen=True)
class Crf:
    """``unary``: score of main text by feature; ``step[a][b]``: score of label b after a; ``first``: of starting with main text."""

    unary: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    first: float

    def scores(self, page: list[Block], cache: dict) -> list[float]:
        out = []
        get = self.unary.get
        base = get("bias", 0.0)
        for i, b in enumerate(page):
            key = (b.tag, b.above)
            s = cache.get(key)
            if s is None:
                if len(cache) > 100_000:
                    cache.clear()
                s = cache[key] = base + sum(get(f, 0.0) for f in structure_features(b))
            for f in text_features(b):
                s += get(f, 0.0)
            out.append(s + get(_place(i, len(page)), 0.0))
        return out

    def decode(self, page: list[Block], cache: dict) -> list[int]:
        """Viterbi: the best labels of the page's blocks."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step
        u = self.scores(page, cache)
        a, b = 0.0, u[0] + self.first
        back: list[tuple[int, int]] = []
        for x in u[1:]:
            to0 = (a + s00, 0) if a + s00 >= b + s10 else (b + s10, 1)
            to1 = (a + s01 + x, 0) if a + s01 > b + s11 else (b + s11 + x, 1)
            back.append((to0[1], to1[1]))
            a, b = to0[0], to1[0]
        label = int(b > a)
        out = [label]
        for prev in reversed(back):
            label = prev[label]
            out.append(label)
        return out[::-1]


def _place(i: int, n: int) -> str:
    return "first" if i == 0 else "last" if i == n - 1 else f"place{4 * i // n}"


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, rate: float = 0.1, l2: float = 0.002, min_rows: int = 2) -> Crf:
    """Maximum-likelihood weights by Adam; the pages are padded to one array, so a step of the
    forward-backward recursion is one operation over all pages."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Crf({}, ((0.0, 0.0), (0.0, 0.0)), 0.0)
    feats = [[["bias", *structure_features(b), *text_features(b), _place(i, len(bs))] for i, b in enumerate(bs)] for bs, _ in pages]
    count: dict[str, int] = {}
    for page in feats:
        for fs in page:
            for f in fs:
                count[f] = count.get(f, 0) + 1
    names = sorted(f for f, n in count.items() if n >= min_rows)
    at = {f: i for i, f in enumerate(names)}
    n_pages, longest = len(pages), max(len(p[0]) for p in pages)
    flat, owner = [], []
    gold = np.zeros((n_pages, longest), np.int64)
    live = np.zeros((n_pages, longest), bool)
    for r, (page, (_, labels)) in enumerate(zip(feats, pages)):
        live[r, :len(page)] = True
        gold[r, :len(page)] = labels
        for i, fs in enumerate(page):
            ids = [at[f] for f in fs if f in at]
            flat += ids
            owner += [r * longest + i] * len(ids)
    flat_, owner_ = np.array(flat), np.array(owner)
    total = live.sum()
    want = np.bincount(flat_, weights=gold.ravel()[owner_], minlength=len(names))
    both = live[:, 1:]
    want_step = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    w = np.zeros(len(names) + 5)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        u = np.bincount(owner_, weights=w[:len(names)][flat_], minlength=n_pages * longest).reshape(n_pages, longest)
        s, first = w[-5:-1].reshape(2, 2), w[-1]
        alpha = np.zeros((longest, n_pages, 2))
        alpha[0, :, 1] = u[:, 0] + first
        for i in range(1, longest):
            for b in (0, 1):
                new = _logsum(alpha[i - 1, :, 0] + s[0, b], alpha[i - 1, :, 1] + s[1, b]) + (u[:, i] if b else 0.0)
                alpha[i, :, b] = np.where(live[:, i], new, alpha[i - 1, :, b])
        z = _logsum(alpha[-1, :, 0], alpha[-1, :, 1])
        beta = np.zeros((longest, n_pages, 2))
        for i in range(longest - 2, -1, -1):
            for a in (0, 1):
                new = _logsum(s[a, 0] + beta[i + 1, :, 0], s[a, 1] + u[:, i + 1] + beta[i + 1, :, 1])
                beta[i, :, a] = np.where(live[:, i + 1], new, 0.0)
        p1 = np.where(live, np.exp(alpha[:, :, 1].T + beta[:, :, 1].T - z[:, None]), 0.0)
        grad = np.zeros_like(w)
        grad[:len(names)] = np.bincount(flat_, weights=p1.ravel()[owner_], minlength=len(names)) - want
        for a in (0, 1):
            for b in (0, 1):
                pair = alpha[:-1, :, a].T + s[a, b] + (u[:, 1:] if b else 0.0) + beta[1:, :, b].T - z[:, None]
                grad[len(names) + 2 * a + b] = np.where(both, np.exp(np.minimum(pair, 0.0)), 0.0).sum() - want_step[a, b]
        grad[-1] = (p1[:, 0] - gold[:, 0]).sum()
        grad = grad / total + l2 * w / len(pages)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad ** 2
        w -= rate * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.999 ** k)) + 1e-8)
    s = w[-5:-1].reshape(2, 2)
    return Crf({f: float(w[i]) for f, i in at.items()}, ((float(s[0, 0]), float(s[0, 1])), (float(s[1, 0]), float(s[1, 1]))), float(w[-1]))


# ---- labelled pages

_OUTSIDE = frozenset("a:nav a:aside a:footer a:form a:header hidden c:comment c:comments c:ad c:share".split())


def label_by_markup(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself; None if it does not."""
    labels = [int(("a:article" in b.above or "a:main" in b.above) and not b.above & _OUTSIDE) for b in page]
    return labels if any(labels) else None


def compose(rng: random.Random, lines: list[str], phrases: list[str]) -> tuple[str, list[str]]:
    """One page in a random layout and the texts of its main blocks, in order.

    The layouts vary what surrounds and holds an article: marked by article, main, section or only by
    a class, with menus, headers, sidebars, notices, adverts, forms, shares, reader comments, footers.
    """
    esc = html_lib.escape

    def line() -> str:
        return rng.choice(lines)

    def short() -> str:
        return rng.choice(phrases)

    def pick(*options: str) -> str:
        return rng.choice(options)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{esc(short())}</a></li>' for i in range(n))

    def unit(tag: str, name: str, inner: str) -> str:
        how = pick("class", "id", "class")
        return f'<{tag} {how}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    n = rng.randint(1, 12)
    main = [(pick("h1", "h1", "h2"), short())] if rng.random() < 0.85 else []
    for i in range(n):
        kind = "h2" if i and rng.random() < 0.08 else "blockquote" if rng.random() < 0.04 else "li" if rng.random() < 0.06 else "p"
        main.append((kind, short() if kind == "h2" or rng.random() < 0.15 else line()))
    ad = unit(pick("div", "aside", "section"), pick("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "adsbygoogle"), f"{pick('', '<p>')}{esc(pick(line(), short()))}")
    pieces = []
    for i, (kind, text) in enumerate(main):
        e = esc(text)
        body = f"<{kind}>{e}</{kind}>" if kind != "li" else f"<ul><li>{e}</li></ul>"
        if kind == "p" and rng.random() < 0.2:
            body = f"<p><b>{e}<br>"
        pieces.append(body)
        if rng.random() < 0.05:
            pieces.append(ad)
        if rng.random() < 0.04:
            pieces.append(unit("div", pick("share", "social-share", "share-buttons"), f"<ul>{links(3)}</ul>"))
        if rng.random() < 0.03:
            pieces.append(unit(pick("aside", "div"), pick("related", "pullquote-related", "related-links"), f"<h3>{esc(short())}</h3><ul>{links(3)}</ul>"))
    holder = rng.randint(0, 5)
    inner = "".join(pieces)
    article = [f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
               unit("div", pick("content", "main-content", "post", "entry-content", "article-body", "story"), inner),
               f"<section{pick('', ' class=\"post\"', ' id=\"story\"')}>{inner}</section>", f'<div role="main">{inner}</div>'][holder]
    menu = f"<ul>{links(rng.randint(3, 8))}</ul>"
    top = [pick(f"<nav>{menu}</nav>", unit("div", pick("menu", "nav", "navbar", "topnav"), menu), f'<div role="navigation">{menu}</div>')]
    if rng.random() < 0.5:
        top.append(pick("<header>{}</header>", '<div class="header">{}</div>', '<div id="site-header">{}</div>', '<div role="banner">{}</div>')
                   .format(pick("<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "{}").format(esc(short())) + (f"<p>{esc(line())}</p>" if rng.random() < 0.4 else "")))
    extras = []
    if rng.random() < 0.45:
        extras.append(ad)
    if rng.random() < 0.4:
        extras.append(unit(pick("div", "section", "aside"), pick("cookie-notice", "cookie", "notice", "banner", "gdpr-consent", "alert", "message"),
                           f"<p>{esc(pick('We use cookies. Accept our privacy terms.', line(), short()))}</p><button>{esc(short())}</button>"))
    if rng.random() < 0.4:
        extras.append(pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<aside class="widget">{}</aside>', '<div role="complementary">{}</div>')
                      .format(f"<h3>{esc(short())}</h3>" + pick(f"<ul>{links(5)}</ul>", f"<p>{esc(line())}</p>", f"<p>{esc(line())}</p><p>{esc(line())}</p>")))
    if rng.random() < 0.3:
        extras.append(f"<form{pick('', ' class=\"search\"', ' id=\"signup\"')}><label>{esc(short())}</label><p>{esc(pick(short(), line()))}</p><button>{esc(short())}</button></form>")
    if rng.random() < 0.2:
        extras.append(unit("div", pick("breadcrumb", "breadcrumbs", "tags", "meta", "byline-links", "pagination"), f"<ul>{links(3)}</ul>"))
    rng.shuffle(extras)
    cut = rng.randint(0, len(extras))
    comments = ""
    if rng.random() < 0.4:
        one = [pick("<article class=\"comment\"><p>{}</p></article>", '<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', "<p>{}</p>").format(esc(pick(line(), short())))
               for _ in range(rng.randint(1, 5))]
        comments = unit(pick("section", "div"), pick("comments", "comment-list", "reader-comments", "discussion", "replies"),
                        f"<h3>{esc(short())}</h3>" + "".join(one))
    foot = pick("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div role="contentinfo">{}</div>').format(
        pick(f"&copy; {esc(short())}", f"<p>&copy; {esc(line())}</p>", f"<ul>{links(4)}</ul><p>{esc(line())}</p>"))
    if holder in (0, 2) and comments and rng.random() < 0.3:
        article = article.replace("</article>", comments + "</article>", 1) if "<article class" not in comments else article + comments
        comments = ""
    body = "".join([*top, *extras[:cut], article, comments, *extras[cut:], foot])
    page = f"<!DOCTYPE html><html><head><title>{esc(short())}</title><script>var a='</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"
    return page, [" ".join(t.split()) for _, t in main]


def label_by_texts(page: list[Block], main: list[str]) -> list[int] | None:
    """Labels of a composed page: its main texts are found in order, as one stretch of matches; None
    if the cut of the page does not hold them all."""
    labels, k = [0] * len(page), 0
    inside = [i for i, b in enumerate(page) if b.above & {"a:article", "a:main", "a:section", "c:content", "c:post", "c:entry", "c:article", "c:story", "c:main"}]
    for i in inside:
        if k < len(main) and page[i].text == main[k]:
            labels[i] = 1
            k += 1
    return labels if k == len(main) else None


def labelled_pages(pages: DataFrame, id_col: str, html_col: str, sampled: int, composed: int, max_chars: int = 200_000,
                   max_marks: int = 1_000_000) -> list[tuple[list[Block], list[int]]]:
    """At most ``sampled`` pages of the table that mark their article, by smallest digest of the id, and
    ``composed`` pages in other layouts made of their texts: the documented bound of the training set. Pages over
    ``max_chars`` characters, or ``max_marks`` marks in their sets and blocks, are extracted but not learned from."""
    texts = pages.select(col(id_col).cast("string").alias("id"), col(html_col).cast("string").alias("t")).where(
        F.col("id").isNotNull() & F.col("t").isNotNull() & (F.length("t") <= max_chars))
    # the ids first: so that no task sends pages that are not picked; the ids are bounded by ``sampled``
    every = texts.select("id").distinct()
    ids = materialise(few(every, sampled, every.count(), "id"), "picked")
    rows = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("t").alias("t")).orderBy("id").collect()
    out, lines, phrases = [], [], []
    for r in rows:
        page = blocks(r["t"], max_marks=max_marks)
        labels = label_by_markup(page)
        if labels is None:
            continue
        out.append((page, labels))
        for b, y in zip(page, labels):
            if y and len(b.text) < 4000:
                (lines if len(b.text) >= 60 else phrases).append(b.text)
    lines, phrases = lines or ["A line of text, long enough to look like one."], phrases or ["A few words"]
    phrases += [" ".join(t.split()[:4]) for t in lines[:len(phrases) + 50]]
    rng = random.Random(7)
    for _ in range(composed):
        text, main = compose(rng, lines, phrases)
        page = blocks(text)
        labels = label_by_texts(page, main)
        if labels is not None:
            out.append((page, labels))
    return out


def extract(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (main blocks joined by two newlines, empty if none), n_chars.

    Null and empty pages, and pages without main text, give the empty text; repeated rows give repeated
    results; an empty table gives an empty result; broken markup is read as far as it goes. The whole page is read,
    with every mark the model knows, at any depth; other columns are not.
    """
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), col(html_col).cast("string").alias("t"))
    known = frozenset(model.unary)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            texts = []
            for cell in b.column(2):
                page = blocks(cell.as_py(), known)
                texts.append("\n\n".join(x.text for x, y in zip(page, sent.value.decode(page, cache)) if y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op4_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(labelled_pages(pages, "page_id", "html", sampled=300, composed=900)))
