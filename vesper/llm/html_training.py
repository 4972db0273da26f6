"""Labelled pages for the extractor: written layouts, filled with random words, each block labelled by its place."""

from __future__ import annotations

import random
import re

from .html import Block, blocks

#: Marks main text in a layout; it never reaches the features.
MAIN = "\x01"
SEED = 7

#: Parts of pages. {w:a-b} is a to b random words, {s:a-b} as many sentences, {m:a-b} sentences of main text.
CHROME_TOP = [
    "<nav><ul>{links:3-9}</ul></nav>",
    '<header class="site-header"><a href="/" class="logo">{w:1-3}</a><p class="tagline">{w:3-8}</p></header>',
    '<div id="header"><h1>{w:1-3}</h1><div class="menu"><ul>{links:3-8}</ul></div></div>',
    '<div class="navbar" role="navigation">{anchors:3-8}</div>',
    '<div class="breadcrumb">{anchors:2-4}</div>',
    '<div class="cookie-notice"><p>{s:1-2}</p><button>{w:1-2}</button></div>',
    '<div id="cookie-banner" class="notice consent">{s:1-3} <a href="/p">{w:1-2}</a></div>',
    '<div class="ad">{s:1-2}</div>',
    '<div class="advert banner"><a href="/x">{w:3-9}</a></div>',
    '<form action="/search" class="search"><label>{w:1-2}</label><input type="text"><button>{w:1-1}</button></form>',
    '<p class="skip"><a href="#main">{w:2-4}</a></p>',
    '<div class="alert notice">{s:1-1}</div>',
    "<ul>{links:3-8}</ul>",
    "<div><p>{s:1-2}</p><button>{w:1-2}</button><button>{w:1-2}</button></div>",
    "<div>{s:1-2}<button>{w:1-2}</button></div>",
    "<form action='/login'><p>{s:1-1}</p><label>{w:1-2}</label><input><label>{w:1-2}</label><input></form>",
    "<header><a href='/'>{w:1-3}</a></header>",
    "<header><h1>{w:1-3}</h1><p>{w:2-6}</p></header>",
    '<header class="site"><h1><a href="/">{w:1-3}</a></h1><p>{s:1-1}</p></header>',
    "<div>{anchors:3-8}</div>",
]
CHROME_SIDE = [
    '<aside class="sidebar"><h3>{w:1-3}</h3><ul>{links:3-8}</ul></aside>',
    '<aside><h2>{w:1-3}</h2><p>{s:1-3}</p></aside>',
    '<div id="sidebar" class="widget"><h4>{w:1-3}</h4><p>{s:1-2}</p><ul>{links:2-6}</ul></div>',
    '<div class="related"><h3>{w:1-3}</h3><ul>{links:2-6}</ul></div>',
    '<div class="newsletter"><h3>{w:2-4}</h3><p>{s:1-2}</p><form><input><button>{w:1-2}</button></form></div>',
    '<div class="share social">{anchors:2-5}</div>',
    '<div class="tags">{anchors:2-6}</div>',
    '<div class="author-bio"><p>{s:1-2}</p></div>',
    '<div class="ad sponsored"><p>{s:1-3}</p></div>',
    '<div class="promo advertisement"><h4>{w:2-5}</h4><p>{s:1-2}</p></div>',
    '<form class="login"><p>{s:1-1}</p><label>{w:1-2}</label><input></form>',
    '<div class="col-md-4"><h4>{w:1-3}</h4><ul>{links:2-5}</ul></div>',
    '<div class="col side"><h4>{w:1-3}</h4><p>{s:1-2}</p></div>',
    '<div class="ad">{s:1-2}</div>',
    '<div class="ad-slot"><p>{s:1-2}</p></div>',
    '<div class="advert">{s:1-2}</div>',
    '<div class="advertisement"><p>{s:1-1}</p></div>',
    '<div class="sponsored"><h4>{w:2-4}</h4><p>{s:1-2}</p></div>',
    '<section class="promo"><p>{s:1-2}</p></section>',
    '<section class="comments"><h3>{w:1-2}</h3>{remarks:1-5}</section>',
    '<div class="comments">{remarks:1-5}</div>',
]
#: Parts of an article that an article's own look doesn't tell from its text; only their names do.
WITHIN = ['<div class="ad">{s:1-2}</div>', '<div class="advert">{s:1-2}</div>', '<div class="ad-slot"><p>{s:1-2}</p></div>', '<div class="advertisement banner"><p>{s:1-2}</p></div>', '<div class="sponsored"><h4>{w:2-4}</h4><p>{s:1-2}</p></div>', "<aside><h3>{w:1-3}</h3><ul>{links:1-4}</ul></aside>", '<div class="related"><p><a href="/r">{w:3-8}</a></p></div>', '<div class="promo">{s:1-1}</div>', '<div class="newsletter"><p>{s:1-1}</p><form><input><button>{w:1-1}</button></form></div>', "<div><p>{s:1-2}</p><input><button>{w:1-2}</button></div>"]
CHROME_END = [
    "<footer>&copy; {w:1-3} &middot; {s:1-2}</footer>",
    "<footer><p>&copy; 2021 {w:1-3}. {s:1-2}</p><ul>{links:2-6}</ul></footer>",
    '<div id="footer" class="footer"><p>{s:1-3}</p>{anchors:2-5}</div>',
    '<div class="comments"><h3>{w:1-3}</h3>{comments:1-5}</div>',
    '<section id="comments" class="comment-list"><h2>{w:1-2}</h2><ol>{commentlis:1-5}</ol></section>',
    '<div id="disqus" class="discussion">{comments:1-4}<form class="reply"><textarea>x</textarea><p>{w:2-5}</p></form></div>',
    '<div class="copyright legal">{s:1-2}</div>',
    '<div class="subscribe cta"><p>{s:1-2}</p></div>',
    '<nav class="pagination">{anchors:2-4}</nav>',
    '<div class="comments">{remarks:1-6}</div>',
    '<section class="comments"><h3>{w:1-2}</h3>{remarks:1-6}</section>',
    '<div id="comments"><ol>{remarklis:1-6}</ol></div>',
    '<div class="thread">{posts:1-5}</div>',
    '<div id="responses" class="replies">{posts:1-4}</div>',
    '<section class="discussion thread"><h2>{w:1-2}</h2>{remarks:1-5}</section>',
    '<div><p>{s:1-2}</p><button>{w:1-2}</button></div>',
    "<div>&copy; {w:1-4}</div>",
]
#: Cells beside and below the story where a table is the layout.
CELLS_SIDE = ["<td>{anchors:2-6}</td>", '<td class="nav">{anchors:2-8}</td>', '<td class="menu"><ul>{links:2-6}</ul></td>', '<td valign="top" id="left">{anchors:1-3}<p>{s:1-2}</p></td>']
CELLS_END = ['<tr><td colspan="2">&copy; 2020 {w:1-3}. {s:1-1}</td></tr>', '<tr><td class="footer">&copy; {w:1-3} {s:1-2}</td></tr>', '<tr><td align="center">{anchors:2-5}</td></tr>', ""]
BODY_PART = ["<p>{m:1-6}</p>", "<p>{m:1-6}</p>", "<p>{m:1-6}</p>", "<p>{m:1-3}", "<p><b>{m:1-4}<br></p>", "<p><b>{m:1-4}<br>", "<p>{m:1-1}</p>", "<p>{mw:1-3}.</p>", "<p>{mw:1-4}</p>", "<h2>{mw:2-7}</h2><p>{m:1-5}</p>", "<h3>{mw:1-6}</h3>", "<ul>{items:2-6}</ul>", "<ol><li>{m:1-2}</li><li>{m:1-2}</li></ol>", "<blockquote><p>{m:1-3}</p></blockquote>", "<blockquote>{m:1-2}</blockquote>", "<p>{m:1-2} <a href='/y'>{mw:1-3}</a> {m:1-2}</p>", "<pre>{m:1-2}</pre>", "<figure><img src='i.png'><figcaption>{mw:3-9}</figcaption></figure>", "<table><tr><td>{mw:1-3}</td><td>{mw:1-4}</td></tr></table>", "<p>{msym:5-30}</p>", "<p>{mlist:5-20}</p>"]
CONTAINERS = [("<article>", "</article>"), ("<article>", ""), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content"><div class="entry-content">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<section class="post story">', "</section>"), ('<div id="main" role="main">', "</div>"), ("<div>", "</div>"), ('<td class="text">', "</td>"), ("", ""), ("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ('<div id="story">', "</div>"), ("<section>", "</section>"), ("<center><font size='2'>", "</font></center>"), ('<div class="container"><div class="row">', "</div></div>"), ('<div class="container"><div class="row"><div class="col-md-8">', "</div></div></div>")]
#: Main text without paragraph tags.
PLAIN_PART = ["<div>{m:1-5}</div>", "<div>{m:2-5}</div>", "<div><span>{m:1-4}</span></div>", "<div>{m:1-3}<br><br>{m:1-3}<br><br>{m:1-3}</div>", "<h2>{mw:2-7}</h2><div>{m:1-5}</div>"]
HEADLINES = ["<h1>{mw:2-12}</h1>", "<h1>{mw:2-12}</h1>", "<h1>{m:1-2}</h1>", "<h1 class='title'>{mw:2-9}</h1>", "<header><h1>{mw:2-9}</h1></header>", "<h2 class='headline'>{mw:2-9}</h2>", ""]


class _Words:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.parts = ["".join(rng.choice("bcdfghlmnprstvwz") * rng.randint(0, 1) + rng.choice("aeiouäéóç") + rng.choice("nrstl") * rng.randint(0, 1) for _ in range(rng.randint(1, 2))) for _ in range(60)]

    def words(self, n: int) -> str:
        return " ".join("".join(self.rng.choices(self.parts, k=self.rng.randint(1, 3))) for _ in range(n))

    def sentence(self) -> str:
        w = self.words(self.rng.choice((1, 2, 3, 6, 9, 12, 15, 20, 25)))
        return w.replace(" ", ", ", self.rng.choice((0, 0, 1, 2)))[:1].upper() + w.replace(" ", ", ", self.rng.choice((0, 0, 1)))[1:] + "."

    def sentences(self, n: int) -> str:
        return " ".join(self.sentence() for _ in range(n))


def _fill(layout: str, words: _Words) -> str:
    rng = words.rng

    def one(m: re.Match) -> str:
        n = rng.randint(int(m[2]), int(m[3]))
        link = lambda: f'<a href="/{rng.randint(1, 999)}">{words.words(rng.randint(1, 3))}</a>'
        match m[1]:
            case "w":
                return words.words(n)
            case "s":
                return words.sentences(n)
            case "m":
                return MAIN + words.sentences(n)
            case "mw":
                return MAIN + words.words(n)
            case "msym":
                return MAIN + " ".join(words.words(1) + rng.choice(("***", "###", "$$$", "&amp;&amp;", "%%%", "!!")) for _ in range(n))
            case "mlist":
                return MAIN + " | ".join(words.words(1) for _ in range(n))
            case "items":
                return "".join(f"<li>{MAIN}{words.sentences(1)}</li>" for _ in range(n))
            case "links":
                return "".join(f"<li>{link()}</li>" for _ in range(n))
            case "anchors":
                return " ".join(link() for _ in range(n))
            case "comments":
                return "".join(f'<div class="comment"><span class="user">{words.words(1)}</span><p>{words.sentences(rng.randint(1, 3))}</p></div>' for _ in range(n))
            case "remarks":
                return "".join(f"<p>{words.sentences(rng.randint(1, 3))}</p>" for _ in range(n))
            case "remarklis":
                return "".join(f"<li>{words.sentences(rng.randint(1, 3))}</li>" for _ in range(n))
            case "posts":
                return "".join(f'<div class="post"><b>{words.words(1)}</b><p>{words.sentences(rng.randint(1, 3))}</p></div>' for _ in range(n))
            case "commentlis":
                return "".join(f'<li class="comment"><p>{words.sentences(rng.randint(1, 3))}</p></li>' for _ in range(n))
        raise ValueError(m[1])

    return re.sub(r"\{(\w+):(\d+)-(\d+)\}", one, layout)


def _plain_to_see(parts: list[str]) -> list[str]:
    """Those that their tags, links or controls tell from an article where no name does."""
    return [x for x in parts if ("{s:" not in x or re.search("<button|<input|<footer|<form|&copy;", x)) and not re.search("comments|remark|posts", x)]


def _unnamed(page: str, rng: random.Random) -> str:
    """Without its classes and ids, or with words in their place that say nothing: one word for each name of the page."""
    if rng.random() < 0.4:
        return re.sub(r""" (?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    known: dict[str, str] = {}
    made = lambda m: known.setdefault(m[0], "".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=rng.randint(3, 6))))
    return re.sub(r"""(?<= )(class|id)=(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", lambda m: f'{m[1]}="{re.sub(r"[a-z]+", made, m[2] or m[3] or m[4] or "")}"', page)


def layout(rng: random.Random) -> str:
    opening, closing = rng.choice(CONTAINERS)
    kind = BODY_PART if rng.random() < 0.85 else PLAIN_PART
    pieces = rng.choices(kind, k=rng.choice((1, 2, 3, 5, 8, 12)))
    nameless = rng.random() < 0.3
    if not nameless and rng.random() < 0.3:
        pieces.insert(rng.randint(0, len(pieces)), rng.choice(WITHIN))
    body = "".join(pieces)
    inner = rng.choice(CHROME_SIDE) if not nameless and rng.random() < 0.25 else ""
    if not nameless and rng.random() < 0.12:
        body += rng.choice(CHROME_END[3:6] + CHROME_END[9:15])
    story = opening + rng.choice(HEADLINES) + (inner + body if rng.random() < 0.5 else body + inner) + closing
    if rng.random() < 0.15:
        cell = f"<td{rng.choice(('', ' class=main', ' valign=top'))}>{story}</td>"
        row = rng.choice(CELLS_SIDE) + cell if rng.random() < 0.7 else cell + rng.choice(CELLS_SIDE)
        if rng.random() < 0.2:
            row = cell
        story = f"<table>{rng.choice(('', '<tr>' + rng.choice(CELLS_SIDE) + '</tr>'))}<tr>{row}</tr>{rng.choice(CELLS_END)}</table>"
    some = _plain_to_see if nameless else list
    pick = lambda parts, most: "".join(rng.sample(some(parts), rng.randint(0, most)))
    if rng.random() < 0.15:
        body = story
    else:
        body = pick(CHROME_TOP, 4) + (pick(CHROME_SIDE, 1) + story if rng.random() < 0.3 else story + pick(CHROME_SIDE, 2)) + pick(CHROME_END, 3)
    if rng.random() < 0.3:
        body = f'<div id="page" class="wrapper">{body}</div>'
    if nameless:
        body = _unnamed(body, rng)
    return "<!DOCTYPE html><html><head><title>{w:2-6}</title><style>p{margin:0}</style></head><body>" + body + rng.choice(("</body></html>", ""))


def labelled_pages(n: int = 900, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        found = blocks(_fill(layout(rng), _Words(rng)))
        labels = [int(any(MAIN in p for p in b.parts)) for b in found]
        for b in found:
            b.parts, b._text = [p.replace(MAIN, "") for p in b.parts], None
        out.append((found, labels))
    return out
