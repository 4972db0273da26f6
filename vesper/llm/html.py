"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop|style)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Their content is no text.
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes select option button canvas audio video head".split())
_UNPARSED = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
#: What can stand in a head; all else, and text, ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text until their end tag; where none follows, until the next block. Those of the second set can hold one another.
_SOFT = RAW - _UNPARSED - {"head"}
_NESTED = frozenset("object template svg math canvas audio video".split())
_SOFT_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_SOFT))})(?=[\s/>])", re.I)
#: An opening tag closes these open ones, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Block tags that lines of text stand in, and that don't make a part of the page by themselves.
_TEXTUAL = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption ul ol dl center tr th caption tbody thead address hgroup".split())
#: What a visitor fills in or presses.
_CONTROLS = frozenset("button input select textarea".split())
FEATURES = 1 << 14
_SENTENCE = re.compile(r"[.!?…。](?:[\"'”’»)\]]*)(?:\s|$)")


class Node:
    """An open tag, and what it adds to its ancestors: its name, if none of them has it and it is a block's, and new words of its class, id and role. Also
    whether it is hidden, whether a control stands right in it, and the part of the page that it belongs to (see part())."""

    __slots__ = ("control", "hidden", "inline", "new", "parent", "part", "score", "tag")

    def __init__(self, parent: Node | None, tag: str, inline: bool, new: tuple[str, ...], hidden: bool = False):
        self.parent, self.tag, self.inline, self.new, self.hidden = parent, tag, inline, new, hidden
        self.score, self.part, self.control = None, None, False

    def above(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


@dataclass
class Block:
    """The text between two block boundaries, its innermost open tag, the two innermost block tags, and how much of it is links and bold.

    Blocks share the nodes of their open tags, so that deep nesting costs no more than the page's length.
    """

    node: Node | None
    ends: tuple[str, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bold: int = 0
    _text: str | None = None

    def text(self) -> str:
        if self._text is None:
            self._text = " ".join(entities.unescape("".join(self.parts)).split())
        return self._text

    @property
    def path(self) -> tuple[str, ...]:
        """The open block tags, outermost first."""
        return tuple(n.tag for n in self.node.above() if not n.inline)[::-1] if self.node else ()


def part(block: Block) -> Node | None:
    """The innermost open tag that makes a part of the page: a block tag that isn't textual, nor a cell whose text stands right in it."""
    node, passed = block.node, []
    while node is not None and (node.inline or node.tag in _TEXTUAL):
        if node.part is not None:
            node = node.part
            break
        passed.append(node)
        node = node.parent
    if node is not None and node.tag == "td" and block.ends[-1:] == ("td",):
        while node is not None and node.tag in ("td", "tr", "tbody", "table"):
            node = node.parent
        return node
    for p in passed:
        p.part = node
    return node


def _unclosed(page: str) -> set[int]:
    """Places of tags such as <button> that no end tag closes: another one opens first, or none follows. What such a tag
    holds ends at the next block."""
    waiting: dict[str, list[int]] = {}
    for m in _SOFT_TAG.finditer(page):
        tag = m[2].lower()
        mine = waiting.setdefault(tag, [])
        if m[1]:
            if mine:
                mine.pop()
        elif tag in _NESTED:
            mine.append(m.start())
        else:
            waiting.setdefault("", []).extend(mine)
            mine[:] = [m.start()]
    return {at for places in waiting.values() for at in places}


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Unclosed and stray tags are borne; the work is linear in the page.

    A block tag ends a block, an inline tag doesn't; <br> is white space. What is hidden, by its attribute or its own style, is no text. An open <p> ends at any block tag, an open head
    at <body>, and at text or a tag that can't stand in a head, and a tag such as <button> that is never closed at the next block tag.
    """
    stack: list[Node] = []
    places: dict[str, list[int]] = {}  # of the open tags of each name in the stack
    words_open: set[str] = set()
    outer: list[int] = []  # of the open tags that aren't inline
    loose: list[int] = []  # of the open tags that nothing closes
    out: list[Block] = []
    now: Block | None = None
    depth = {"raw": 0, "a": 0, "b": 0}
    unclosed = _unclosed(page)
    ends_of: dict[str, list[int]] = {}  # where the end tags of unparsed tags are
    at, n = 0, len(page)

    def last(tag: str) -> int:
        at = places.get(tag)
        return at[-1] if at else -1

    def end_of(tag: str, at: int) -> int:
        if tag not in ends_of:
            ends_of[tag] = [m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)]
        i = bisect_left(ends_of[tag], at)
        return ends_of[tag][i] if i < len(ends_of[tag]) else n

    def say(text: str) -> None:
        nonlocal now
        if stack and stack[-1].tag == "head" and text and not text.isspace():
            pop(len(stack) - 1)
        if not text or depth["raw"]:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(stack[-1] if stack else None, tuple(stack[i].tag for i in outer[-2:]))
            out.append(now)
        now.parts.append(text)
        now.linked += len(text) * (depth["a"] > 0)
        now.bold += len(text) * (depth["b"] > 0)

    def pop(to: int) -> None:
        nonlocal now
        for _ in range(len(stack) - to):
            node = stack.pop()
            t = node.tag
            places[t].pop()
            words_open.difference_update(node.new)
            if loose and loose[-1] == len(stack):
                loose.pop()
            if t in RAW or node.hidden:
                depth["raw"] -= 1
            elif t == "a":
                depth["a"] -= 1
            elif t in ("b", "strong", "h1", "h2", "h3"):
                depth["b"] -= 1
            if not node.inline:
                outer.pop()
                now = None

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            i = last(tag)
            if tag == "p" and i < 0:
                now = None
            elif i >= 0 and (tag not in INLINE or not outer or i > outer[-1]):
                pop(i)
            continue
        if tag == "body" and last("head") >= 0:
            pop(last("head"))
        elif stack and stack[-1].tag == "head" and tag not in _IN_HEAD:
            pop(len(stack) - 1)
        if loose and tag not in INLINE and tag not in VOID and tag not in RAW and tag != "optgroup":
            pop(loose[0])
        if tag in _CONTROLS and outer:
            stack[outer[-1]].control = True
        if tag in VOID:
            if tag in ("br", "img", "input", "wbr"):
                say(" " if tag != "wbr" else "")
            else:
                now = None
            continue
        if tag not in INLINE:
            now = None
            if outer and stack[outer[-1]].tag == "p":  # a paragraph, and what is open in it, ends here
                pop(outer[-1])
            closes, within = _CLOSES.get(tag, ((), ()))
            i = max(map(last, closes), default=-1)
            if i > max(map(last, within), default=-1):
                pop(i)
        words: set[str] = set()
        hidden = False
        if m[3]:
            own = [(k.lower(), a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])]
            words = {f"name {w}" for k, v in own if k in ("class", "id", "role", "itemprop") for w in _WORD.findall(v.lower())}
            hidden = any(k == "hidden" or (k == "style" and _UNSEEN.search(entities.unescape(v))) for k, v in own)
            if any(k == "aria-hidden" and v == "true" for k, v in own):
                words.add("name hidden")
        if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        new = [w for w in words if w not in words_open] + [f"under {tag}"] * (tag not in INLINE and last(tag) < 0)
        words_open.update(new)
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        if m.start() in unclosed:
            loose.append(len(stack))
        stack.append(Node(stack[-1] if stack else None, tag, tag in INLINE, tuple(sorted(new)), hidden))
        if tag in RAW or hidden:
            depth["raw"] += 1
            if tag in _UNPARSED:
                at = end_of(tag, at)
        elif tag == "a":
            depth["a"] += 1
        elif tag in ("b", "strong", "h1", "h2", "h3"):
            depth["b"] += 1
    return [b for b in out if b.text()]


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def _level(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def _linked(b: Block) -> float:
    return b.linked / max(1, sum(map(len, b.parts)))


def around(page: list[Block]) -> list[list[int]]:
    """Slots of how each block's part (see part()) stands in the page: how much of the page's prose it holds, how dense that is, whether it has controls, whether
    it is the one with the most, or comes before, between or after the blocks of that one, and the shape of the neighbours."""
    parts = [part(b) for b in page]
    words = [b.text().count(" ") + 1 for b in page]
    linked = [_linked(b) for b in page]
    prose = [w if x < 0.3 and w >= 5 else 0 for w, x in zip(words, linked, strict=True)]
    mass, size, paragraphs, links = {}, {}, {}, {}
    for p, m, w, x in zip(parts, prose, words, linked, strict=True):
        mass[p] = mass.get(p, 0) + m
        size[p] = size.get(p, 0) + w
        links[p] = links.get(p, 0) + w * x
        paragraphs[p] = paragraphs.get(p, 0) + (m > 0)
    total = max(1, sum(mass.values()))
    top = max(mass, key=lambda p: mass[p], default=None)
    inside = [i for i, p in enumerate(parts) if p is top]
    first, last = (inside[0], inside[-1]) if inside else (0, -1)
    telling = any(p is not None and p.tag in ("article", "main") for p in parts)
    shape = [f"{_level(w, (2, 4, 8, 15, 30))}{_level(x, (0.2, 0.5, 0.9))}" for w, x in zip(words, linked, strict=True)]
    known: dict = {}
    out = []
    for i, p in enumerate(parts):
        if p not in known:
            held = mass[p]
            level = _level(held / total, (0.02, 0.1, 0.25, 0.5, 0.8))
            own = [f"mass {level}", f"most {p is top and held > 0}", f"paragraphs {_level(paragraphs[p], (1, 2, 3, 6))}", f"prose {_level(held, (1, 15, 30, 60, 120))}", f"dense {_level(links[p] / max(1, size[p]), (0.05, 0.2, 0.5))}", f"control {p.control if p else False}", f"top level {p is None or p.tag == 'body'}"]
            own += [f"telling {telling} {own[0]}", f"{own[1]} {own[2]}", f"{own[1]} {own[5]}", f"{own[5]} {own[3]}", f"telling {telling} {own[1]}"]
            known[p] = own
        side = "in" if p is top else "before" if i < first else "after" if i > last else "between"
        b = page[i]
        tag = b.ends[-1] if b.ends else "-"
        w = _level(words[i], (2, 4, 8, 15, 30))
        more = [f"side {side}", f"side {side} {known[p][0]}", f"side {side} {w}", f"side {side} {tag}", f"next {shape[i + 1] if i + 1 < len(page) else '-'}", f"prior {shape[i - 1] if i else '-'}", f"{known[p][1]} {tag}"]
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            more += [f"heads {i + 1 < len(page) and parts[i + 1] is top} {side}", f"heading {tag} {i + 1 < len(page) and parts[i + 1] is p}"]
        out.append([_slot(x) for x in known[p] + more])
    return out


def _own(page: list[Block], i: int) -> list[int]:
    """Slots of what a block has of its own: its innermost tags, the shape of its text, and whether it is first or last."""
    b = page[i]
    text = b.text()
    n, words = len(text), text.count(" ") + 1
    linked = _linked(b)
    shape = (
        f"words {_level(words, (2, 4, 8, 15, 30, 60))}", f"links {_level(linked, (0.01, 0.2, 0.5, 0.9))}", f"ends {_level(len(_SENTENCE.findall(text)), (1, 2, 4))}",
        f"stop {text[-1] in '.!?…:;\"”»'}", f"commas {_level(text.count(',') / words, (0.01, 0.05, 0.2))}", f"digits {_level(sum(map(str.isdigit, text)) / n, (0.05, 0.2, 0.5))}",
        f"bold {b.bold > 0.5 * n}", f"symbol {any(c in text for c in '©|»›•·®')}",
    )
    tag = b.ends[-1] if b.ends else "-"
    own = [f"tag {tag}", f"parents {'/'.join(b.ends)}", *shape, f"{shape[0]} {shape[1]}", f"{tag} {shape[0]}", f"{tag} {shape[1]}"]
    own += ["first"] * (i == 0) + ["last"] * (i == len(page) - 1) + ["bias"]
    return [_slot(x) for x in own]


def features(page: list[Block]) -> list[list[int]]:
    """Slots of each block's binary features: ancestor tags, the words on them, its text's shape, and how its part of the page stands; nothing of its wording."""
    return [_own(page, i) + near + [_slot(x) for node in (b.node.above() if b.node else ()) for x in node.new] for i, (b, near) in enumerate(zip(page, around(page), strict=True))]


def emissions(page: list[Block], model: Crf) -> np.ndarray:
    """The sum of the weights of each block's features(), by label. What ancestors add is summed once for each open tag."""

    def inherited(node: Node | None) -> np.ndarray:
        fresh = []
        while node is not None and node.score is None:
            fresh.append(node)
            node = node.parent
        score = node.score if node else np.zeros(2)
        for node in reversed(fresh):
            node.score = score = score + model.emit[[_slot(x) for x in node.new]].sum(axis=0) if node.new else score
        return score

    return np.array([model.emit[_own(page, i) + near].sum(axis=0) + inherited(b.node) for i, (b, near) in enumerate(zip(page, around(page), strict=True))]).reshape(-1, 2)


@dataclass(frozen=True)
class Crf:
    """Weights of each feature and label (0 boilerplate, 1 main text), of label pairs, and of the first label."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, page: list[list[int]]) -> list[int]:
        """The most probable label sequence (Viterbi)."""
        return self.viterbi(np.array([self.emit[f].sum(axis=0) for f in page]))

    def viterbi(self, scores: np.ndarray) -> list[int]:
        if not len(scores):
            return []
        move, best, back = self.move.tolist(), (self.start + scores[0]).tolist(), []
        for s in scores[1:].tolist():
            from_0 = [best[1] + move[1][y] > best[0] + move[0][y] for y in (0, 1)]
            best = [(best[1] + move[1][y] if from_0[y] else best[0] + move[0][y]) + s[y] for y in (0, 1)]
            back.append(from_0)
        label = int(best[1] > best[0])
        labels = [label]
        for b in reversed(back):
            label = int(b[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by gradient ascent (Adam) over all pages at once, with forward and backward sums."""
    pages = [p for p in pages if p[0]]
    longest = max((len(x) for x, _ in pages), default=1)
    n = len(pages)
    used = sorted({f for x, _ in pages for b in x for f in b})
    column = {f: i for i, f in enumerate(used)}
    at, feature, labels, length = [], [], np.zeros((n, longest), int), np.array([len(x) for x, _ in pages])
    for i, (x, y) in enumerate(pages):
        labels[i, : len(y)] = y
        for t, b in enumerate(x):
            at += [i * longest + t] * len(b)
            feature += [column[f] for f in b]
    at, feature = np.array(at, int), np.array(feature, int)
    there = np.arange(longest) < length[:, None]
    gold = np.eye(2)[labels] * there[..., None]
    weights = [np.zeros((len(used), 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    pair_gold = np.einsum("nta,ntb->ab", gold[:, :-1] * there[:, 1:, None], gold[:, 1:])
    add = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for step in range(1, steps + 1):
        emit, move, start = weights
        scores = np.stack([np.bincount(at, emit[feature, y], n * longest) for y in (0, 1)], axis=-1).reshape(n, longest, 2)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = start + scores[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(there[:, t, None], add(forward[:, t - 1, :, None] + move, 1) + scores[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(there[:, t + 1, None], add(move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0)
        total = add(forward[:, -1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        pair = np.exp(forward[:, :-1, :, None] + move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        gap = (gold - node).reshape(-1, 2)
        slopes = [np.stack([np.bincount(feature, gap[at, y], len(used)) for y in (0, 1)], axis=-1) / n, (pair_gold - pair.sum(axis=(0, 1))) / n, (gold[:, 0] - node[:, 0]).sum(axis=0) / n]
        for k, g in enumerate(slopes):
            g = g - decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    emit = np.zeros((FEATURES, 2))
    emit[used] = weights[0]
    return Crf(emit, weights[1], weights[2])


def main_text(page: str | None, model: Crf) -> str:
    """Blocks that the model labels as main text, joined by newlines; empty if there is none."""
    found = blocks(page or "")
    return "\n".join(b.text() for b, y in zip(found, model.viterbi(emissions(found, model)), strict=True) if y)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    """Trained on the labelled pages of html_training; the same weights each time."""
    from .html_training import labelled_pages

    return train([(features(x), y) for x, y in labelled_pages()])


def extract(pages: DataFrame, html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """Adds text (main text) and n_chars (its code points) to pages, from the whole html.

    Null or empty html, or no main text: an empty text. Columns named text or n_chars are replaced. Repeated rows:
    each is extracted. Empty table: no rows.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(F.col(f"`{html_col}`").alias("html"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x, shared.value) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    found = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())]))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], "text", "n_chars")
