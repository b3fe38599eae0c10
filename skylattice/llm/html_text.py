"""Main text of web pages: the maximum-scoring contiguous region of the page's tokens.

A page is a sequence of words and tags. Each word is scored by a linear model of where it stands
(tags around it, parts of their class, id and role names, links, inside or outside of the article),
each tag by its name; all weights are fitted on labelled pages, none is set by hand. Words of text
come out positive, words of menus, adverts, comments and the like and all tags negative. One linear
scan finds the contiguous region of the largest sum; the words in it that score positive are the text.
"""

from __future__ import annotations

import html
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: Labelled pages that the weights are fitted on: a bound, whatever the input.
SAMPLE = 1200
#: Weights are whole numbers, so that sums are exact in any order.
UNIT = 1000
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+(?:[-_][a-z0-9]+)*")
#: First parts of names that say what a wrapper has, not what it is.
_ABOUT = {"has", "with", "no", "without", "non", "is", "not"}
#: Elements whose content is no text of the page.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that end a block.
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BODY = {"article", "main"}


def features(name: str, attributes: str) -> list[str]:
    """What an element is known by: its tag, and the whole, first and last part of its names."""
    out = [] if name == "a" else [f"t:{name}"]  # links count by the block
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            for token in _TOKEN.findall((m[1] or m[2] or m[3] or "").lower()):
                parts = re.split("[-_]", token)
                out += ["n:about"] if parts[0] in _ABOUT and len(parts) > 1 else [f"n:{x}" for x in {token, parts[0], parts[-1]}]
    return out


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """('text', decoded), ('<name', attributes) and ('/name', '') in page order; comments and the content of
    raw elements are left out, a tag that is cut off at the end too. Time is linear in the page."""
    at, end, never, quotes = 0, len(page), set(), True
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            break
        follows = page[lt + 1 : lt + 2]
        m = _NAME.match(page, lt)
        if not m and follows not in ("!", "?"):  # a sign, not a tag
            nxt = page.find("<", lt + 1)
            nxt = end if nxt < 0 else nxt
            yield "text", html.unescape(page[at:nxt])
            at = nxt
            continue
        if lt > at:
            yield "text", html.unescape(page[at:lt])
        if not m:
            if page.startswith("<!--", lt):
                close, n = page.find("-->", lt + 4), 3
            elif page.startswith("<![CDATA[", lt):
                close, n = page.find("]]>", lt), 3
                yield "text", page[lt + 9 : close if close >= 0 else end]
            else:
                close, n = page.find(">", lt), 1
            at = end if close < 0 else close + n
            continue
        close = _QUOTED.match(page, m.end()).end() if quotes else page.find(">", m.end())
        if quotes and close < end and page[close] != ">":  # a quote that nothing ends: from here on quotes mean nothing
            quotes, close = False, page.find(">", m.end())
        if close < 0 or close >= end:
            return
        name, attributes, at = m[1].lower(), page[m.end() : close], close + 1
        if page[lt + 1] == "/":
            yield "/" + name, ""
            continue
        yield "<" + name, attributes
        if name in _RAW and name not in never and not attributes.endswith("/"):
            stop = re.compile(f"</{name}", re.I | re.A).search(page, at)
            if stop:
                at = stop.start()
            elif name in ("script", "style"):
                return
            else:
                never.add(name)  # not closed: what follows is page
    if at < end:
        yield "text", html.unescape(page[at:])


class _Path:
    """The features that hold at a place: those since the innermost article, and (outer) those around it.
    total is the sum of their weights."""

    def __init__(self, weights: dict[str, int] | None):
        self.weights, self.total = weights, (weights or {}).get("bias", 0)
        self.inner: Counter = Counter()
        self.outer: Counter = Counter()

    def change(self, side: Counter, f: str, by: int) -> None:
        was = side[f]
        side[f] = was + by
        if not side[f]:
            del side[f]
        if self.weights is not None and bool(was) != bool(was + by):
            w = self.weights.get(f if side is self.inner else f"outer:{f}", 0)
            self.total += w if by > 0 else -w

    def enter(self) -> dict[str, int]:
        """An article begins: what holds is outer now."""
        moved = dict(self.inner)
        for f, n in moved.items():
            self.change(self.inner, f, -n)
            self.change(self.outer, f, n)
        return moved

    def leave(self, moved: dict[str, int]) -> None:
        for f, n in moved.items():
            self.change(self.outer, f, -n)
            self.change(self.inner, f, n)

    def names(self) -> frozenset[str]:
        return frozenset(self.inner) | {f"outer:{f}" for f in self.outer}


def _matched(seq: list[tuple[str, str]]) -> dict[int, int]:
    """Index of each opening tag that has an ending one -> index of that; and the reverse."""
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    out: dict[int, int] = {}
    for i, (kind, attributes) in enumerate(seq):
        name = kind[1:]
        if kind[0] == "<" and name not in _VOID and not attributes.endswith("/"):
            stack.append((name, i))
            opened[name] += 1
        elif kind[0] == "/" and opened[name]:
            while True:
                was, k = stack.pop()
                opened[was] -= 1
                if was == name:
                    out[k], out[i] = i, k
                    break
    return out


def typed(page: str, weights: dict[str, int] | None = None) -> list[tuple[str, str, int, object]]:
    """(type, text, words, score) of each token: type w for text, t:name for a tag. Without weights, the score
    of a text is the set of features that hold there.

    An element that is never ended holds to the next tag that begins a block, so that it takes nothing of
    the rest of the page with it.
    """
    seq = list(tokens(page))
    ends = _matched(seq)
    count = [len(t.split()) if kind == "text" else 0 for kind, t in seq]
    inside = depth = 0
    bodies = {i for i in ends if seq[i][0][1:] in _BODY}
    for i, n in enumerate(count):
        depth += (i < ends[i]) - (i > ends[i]) if i in bodies else 0
        inside += n * (depth > 0)
    body = 2 * inside > sum(count)  # most of the page stands in articles
    path, out = _Path(weights), []
    held: dict[int, tuple[list[str], dict | None]] = {}
    loose: list[str] = []
    links = _linked(seq, count, ends)
    depth = 0

    def tag(name: str) -> tuple[str, str, int, object]:
        """Where words would be negative, tags weigh nothing: what stands there is one run of furniture."""
        return f"t:{name}", "", 0, 0 if weights is None or path.total < 0 else weights.get(f"tag:{name}", weights["tag:"])

    for i, (kind, text) in enumerate(seq):
        if kind == "text":
            n = count[i]
            own = [f"{'in:' if depth else ''}link:{'some' if links[i] == 1 else 'all'}"] if links[i] else []
            own += ["outside"] if body and not depth else []
            if weights is None:
                score: object = path.names() | set(own)
            else:
                score = path.total + sum(weights.get(f, 0) for f in own)
            out.append(("w", text, n, score))
            continue
        name = kind[1:]
        if kind[0] == "/":
            out.append(tag(name))
            if i in ends:
                own, moved = held.pop(ends[i])
                depth -= moved is not None
                for f in own:
                    path.change(path.inner, f, -1)
                if moved is not None:
                    path.leave(moved)
            continue
        at = len(out)
        out.append(tag(name))
        if name in _BLOCK:
            for f in loose:
                path.change(path.inner, f, -1)
            loose = []
        if name in _VOID:
            continue
        own = features(name, text)
        own = own if weights is None else [f for f in own if f in weights or f"outer:{f}" in weights]
        if i in ends:
            moved = path.enter() if name in _BODY else None
            depth += moved is not None
            held[i] = own, moved
            if moved is not None:  # what was loose is around the article now and ends with it
                for f in loose:
                    moved[f] -= 1
                    path.change(path.outer, f, -1)
                loose, held[i] = [], (own, {f: n for f, n in moved.items() if n})
        else:
            loose += own
        for f in own:
            path.change(path.inner, f, 1)
        out[at] = tag(name)
    return out


def _linked(seq: list[tuple[str, str]], count: list[int], ends: dict[int, int]) -> list[int]:
    """For each token: 2 in a block of nothing but links, 1 in a block that has some, else 0."""
    out, block, all_, linked, deep = [0] * len(seq), [], 0, 0, 0
    for i, (kind, _) in enumerate([*seq, ("<p", "")]):
        if kind == "text":
            block.append(i)
            all_ += count[i]
            linked += count[i] * (deep > 0)
        elif kind[1:] == "a" and i in ends:
            deep += 1 if i < ends[i] else -1
        elif kind[1:] in _BLOCK:
            for k in block if linked else ():
                out[k] = 2 if linked == all_ else 1
            block, all_, linked = [], 0, 0
    return out


#: Names that the made-up pages use; the weights of what they say are fitted, and unknown names weigh nothing.
FURNITURE = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright discussion disqus feedback footer gdpr header "
    "masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promotion promoted related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets"
).split()
CONTENT = "content article post entry main body text story page wrapper container column primary prose markdown section document".split()
_SIDE = "top bottom left right site page box list area block wrap item inner section global mobile".split()


def labelled_pages(n: int = SAMPLE, seed: int = 7) -> Iterator[tuple[str, str]]:
    """Made-up pages in several layouts, as (html, main text). Words of the main text and other words are of
    different letters, so that what a word belongs to is plain; the words themselves are no features."""
    rng = random.Random(seed)
    words = lambda letters, a, z: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(a, z)))
    good, other = (lambda a, z: words("aeioulnrst", a, z)), (lambda a, z: words("bcdfghkmpvwxy", a, z))
    pick = rng.choice

    def name(of: list[str]) -> str:
        x = pick(of)
        x = pick([x, x, f"{x}-{pick(_SIDE)}", f"{pick(_SIDE)}-{x}", f"{x}_{pick(_SIDE)}"])
        return pick([f'class="{x}"', f"id='{x}'", f'class="{x} c{rng.randint(1, 9)}"', f"class={x}", f'role="{x}"'])

    def links(a: int, z: int) -> str:
        return "<ul>" + "".join(f"<li><a href=/{i}>{other(1, 3)}</a></li>" for i in range(rng.randint(a, z))) + "</ul>"

    def furniture(inner: bool) -> str:
        """An element that is no part of the text, by its tag, its name or (outside of articles) by its links or place alone."""
        text = pick([lambda: other(2, 25), lambda: f"<p>{other(2, 25)}</p>" * rng.randint(1, 4), lambda: links(2, 9), lambda: f"<h3>{other(1, 3)}</h3><p>{other(3, 60)}</p><p><a href=/>{other(1, 3)}</a></p>"])()
        kind = rng.random()
        if kind < 0.25:
            tag = pick(["nav", "footer", "aside", "form", "header", "menu", "dialog"] if not inner else ["nav", "aside", "form", "menu", "dialog"])
            return f"<{tag}>{text}</{tag}>"
        if kind < 0.32:
            return pick([f"<button>{other(1, 3)}</button>", f"<form><label>{other(1, 3)}</label><input><button>{other(1, 2)}</button></form>", f"<datalist><option>{other(1, 2)}</option></datalist>", f"<script>{other(2, 9)}</script>", f"<style>{other(1, 3)}</style>"])
        if kind < 0.45:
            replies = "".join(pick([f"<article>{x}</article>", f'<article {name(["comment", "reply"])}>{x}</article>', f"<div>{x}</div>"]) for x in [f"<p>{other(3, 40)}</p>" for _ in range(rng.randint(1, 5))])
            return f"<section {name(['comments', 'discussion', 'replies', 'disqus', 'respond'])}><h2>{other(1, 2)}</h2>{replies}</section>"
        if kind > 0.9 and not inner:
            return pick([f"<div>{links(3, 9)}</div>", f"<div><div>{other(2, 12)}</div></div>", f"<p><a href=/>{other(1, 4)}</a> <a href=/>{other(1, 4)}</a></p>"])
        tag = pick(["div", "div", "section", "p", "ul", "span"])
        text = f"<li>{other(2, 9)}</li>" if tag == "ul" else other(2, 25) if tag in ("p", "span") else text
        return f"<{tag} {name(FURNITURE)}>{text}</{tag}>"

    for _ in range(n):
        if rng.random() < 0.06:  # little or no markup
            t = good(1, 60)
            yield pick([t, f"<p>{t}", f"<!-- {other(1, 3)} --><div>{t}</div>", f"<html><body>{t}</body></html>", f"<body><nav>{links(1, 5)}</nav>{t}<footer>{other(1, 9)}</footer></body>"]), t
            continue
        text: list[str] = []

        def block(kind: str = "") -> str:
            one = lambda a, z: (text.append(good(a, z)), text[-1])[1]
            kind = kind or pick("p p p p p s s h l l t q c i a b u".split())
            if kind == "a":  # a link amid text, or all of a paragraph
                a, b, c = (good(3, 20), good(1, 4), good(2, 9)) if rng.random() < 0.85 else ("", good(1, 9), "")
                text.append(f"{a} {b} {c}".strip())
                return f"<p>{a} <a href='/x'>{b}</a> {c}</p>"
            if kind == "b":
                a, b = good(2, 30), good(1, 9)
                text.append(f"{a} {b}")
                return f"<p>{a} <b>{b}</b>" + pick(["", "</p>"])
            make = {
                "p": lambda: f"<p>{one(4, 90)}</p>", "s": lambda: f"<p>{one(1, 3)}</p>", "h": lambda: f"<h2>{one(1, 6)}</h2>", "l": lambda: "<ul>" + "".join(f"<li>{one(1, 12)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>",
                "t": lambda: f"<table><tr><td>{one(1, 4)}</td><td>{one(1, 4)}</td></tr><tr><th>{one(1, 4)}</th></tr></table>", "q": lambda: f"<blockquote><p>{one(3, 30)}</p></blockquote>", "c": lambda: f"<pre><code>{one(1, 20)}</code></pre>",
                "i": lambda: f"<figure><img src=x><figcaption>{one(1, 9)}</figcaption></figure>", "u": lambda: f"<ol><li><p>{one(1, 12)}<li>{one(1, 9)}</ol>",
            }
            return make[kind]()

        inside = pick([0.05, 0.4])
        body = pick(["article", "article", "main", "div", "div", "both"])
        title = f"<h1>{(text.append(good(2, 9)), text[-1])[1]}</h1>"
        inner = pick([title, f"<header>{title}</header>" if body != "div" else title])
        for _ in range(rng.randint(1, 12)):
            inner += furniture(True) if rng.random() < inside else ""
            inner += block()
        inner = f"<div {name(CONTENT)}>{inner}</div>" if rng.random() < 0.3 else f"<section>{inner}</section>" if rng.random() < 0.1 else inner
        tail = "".join(furniture(True) for _ in range(pick([0, 0, 1])))
        open_ = f" {name(CONTENT)}" if rng.random() < 0.3 else f' class="{pick(["with-sidebar no-ads", "post ad-free", "ad-free", "entry popup-free"])}"' if rng.random() < 0.12 else ""
        core = f"<{body}{open_}>{inner}{tail}</{body}>" if body != "both" else f"<main><article{open_}>{inner}{tail}</article></main>"
        if body != "div" and rng.random() < 0.12:  # names of wrappers around an article say nothing of it
            core = f"<div {name(FURNITURE)}>{core}</div>"
        core = f'<div class="{pick(["has", "with", "no"])}-{pick(FURNITURE)}">{core}</div>' if rng.random() < 0.15 else f"<div>{core}</div>" if rng.random() < 0.3 else core
        if body == "div" and rng.random() < 0.5:  # a page that names nothing: only the order of words and tags tells
            bare = lambda: "".join(pick([f"<div>{links(2, 9)}</div>", f"<div><div>{other(1, 9)}</div></div>", f"<div><div><p>{other(1, 7)}</p></div></div>", f'<div class="x{rng.randint(10, 99)}"><span>{other(1, 5)}</span></div>']) for _ in range(rng.randint(1, 5)))
            yield f"<html><head><title>{text[0]}</title></head><body><div>{bare()}</div><div>{core}</div><div>{bare()}</div></body></html>", "\n\n".join(text)
            continue
        core = f"<form>{core}</form>" if body != "div" and rng.random() < 0.05 else core
        side = lambda: "".join(furniture(False) for _ in range(rng.randint(0, 5)))
        yield f"<!DOCTYPE html><html><head><title>{text[0]}</title></head><body>{side()}{core}{side()}</body></html>", "\n\n".join(text)


def fit(pages: Iterator[tuple[str, str]], sample: int = SAMPLE, ridge: float = 0.05, least: int = 8) -> dict[str, int]:
    """Weights from at most `sample` labelled pages. Words: a logistic regression of standing in the main text
    on the features of the place (those that `least` texts have). Tags: log-odds of standing between its first
    and last word, negative for all. What negative words and tags count in the sum (in thousandths) are the
    values of LEANS with which most of the first 200 pages come out right."""
    seen: dict[frozenset, list[float]] = {}
    within, outside, kept = Counter(), Counter(), []
    for k, (page, text) in enumerate(pages):
        if k >= sample:
            break
        rows, main = typed(page), set(text.split())
        kept.append((page, text))
        mine = [bool(n) and main.issuperset(t.split()) for _, t, n, _ in rows]
        a, z = (mine.index(True), len(mine) - mine[::-1].index(True)) if True in mine else (0, 0)
        for i, (kind, _, n, names) in enumerate(rows):
            if kind == "w" and n:
                seen.setdefault(names, [0.0, 0.0])[mine[i]] += 1 + math.log(n)
            elif kind != "w":
                (within if a <= i < z else outside)[kind[2:]] += 1
    common = Counter(f for names in seen for f in names)
    columns = {f: i for i, f in enumerate(["bias", *sorted(f for f in common if common[f] >= least)])}
    x = np.zeros((len(seen), len(columns)))
    for r, names in enumerate(seen):
        x[r, [0, *(columns[f] for f in names if f in columns)]] = 1
    no, yes = np.array(list(seen.values())).reshape(-1, 2).T
    b = np.zeros(len(columns))
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (yes - (yes + no) * p) - ridge * b
        step = np.linalg.solve((x.T * ((yes + no) * p * (1 - p))) @ x + ridge * np.eye(len(b)), grad)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    out = {f: round(UNIT * b[i]) for f, i in columns.items()}
    odds = lambda k: math.log((within[k] + 0.5) / (outside[k] + 0.5))
    every = {k: min(round(UNIT * (odds(k) - 1)), -UNIT // 100) for k in {*within, *outside}}
    out |= {f"tag:{k}": v for k, v in every.items()} | {"tag:": -UNIT // 20}  # the last: a tag that no labelled page has
    rows = [(typed(page, out), text) for page, text in kept[:200]]
    right = {lean: sum(chosen(r, *lean) == text for r, text in rows) for lean in itertools.product(LEANS, LEANS)}
    best = max(right, key=lambda lean: right[lean])
    return out | {"lean:word": best[0], "lean:tag": best[1]}


#: Thousandths that negative scores can count.
LEANS = (1000, 500, 200, 100, 50, 20, 10, 5, 2)


def scores(rows: list[tuple[str, str, int, int]], word: int, tag: int) -> list[int]:
    """Each token's part in the sum. A run of positive words counts by the word; one of negative words grows with
    its logarithm: long furniture amid an article must not outweigh the article before it."""
    return [w * n * UNIT if w > 0 else word * int(w * (1 + math.log(n))) if n else tag * w if kind != "w" else 0 for kind, _, n, w in rows]


def region(scores: list[int], words: list[int]) -> tuple[int, int]:
    """First and one past the last token of the best contiguous region, (0, 0) if no word scores; of equal
    regions the first."""
    best, span, total, start = 0, (0, 0), 0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0, i
        total += s
        if words[i] and total > best:
            best, span = total, (start, i + 1)
    return span


def chosen(rows: list[tuple[str, str, int, int]], word: int, tag: int) -> str:
    """Blocks of the best region, white space within a block as one space, joined by two line ends."""
    a, z = region(scores(rows, word, tag), [n for _, _, n, _ in rows])
    blocks: list[list[str]] = [[]]
    for kind, text, n, w in rows[a:z]:
        if kind == "w":
            blocks[-1].append(text if w > 0 else " " if n == 0 else "")
        elif kind[2:] in _BLOCK:
            blocks.append([])
        elif kind == "t:br":
            blocks[-1].append(" ")
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(x for x in lines if x)


def main_text(page: str | None, weights: dict[str, int]) -> str:
    return chosen(typed(page, weights), weights["lean:word"], weights["lean:tag"]) if page else ""


def extract(pages: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    Null, empty and wordless pages have an empty text; repeated rows each have a row; other columns
    are ignored. Whole pages are read, and nothing of the region that scores positive is cut.
    """
    weights = fit(labelled_pages()) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return bounded(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
